"""The pattern of demonstratives fails at the first character of a text that can begin none."""

import re

from kotomill.functions import japanese as ja


def test_the_pattern_begins_with_what_demonstratives_begin_with():
    ahead = re.match(r"\(\?=\[([^]]+)\]\)", ja.DEMONSTRATIVE)
    assert ahead and set(ahead[1]) == {w[0] for w in (*ja.PRONOUNS, *ja.DETERMINERS, *ja.ADVERBS)}
