"""What findings say. {t} is the hit or the threshold, {a} the base or the value seen, {b} the other style, {x} the replacement."""

# Messages by rule.
TEXT = {
    "D001": "文体が基準の{a}と一致しません（{b}）。",
    "D002": "NFCで合成可能な文字列です。",
    "D003": "括弧「{t}」の対応が一致しません。",
    "D004": "禁止語「{t}」が使われています。",
    "D005": "「{t}」は「{x}」に統一してください。",
    "D006": "同一の語句が連続しています。",
    "D007": "固定的な二重否定「{t}」が使われています。",
    "D008": "「{t}」は「{x}」に置き換えられます。",
    "H101": "文の長さが閾値{t}を超えています（{a}）。",
    "H102": "述語groupを{a}件検出しました（閾値{t}）。",
    "H103": "文中の読点数が閾値{t}を超えています（{a}）。",
    "H104": "括弧の最大ネスト深度が閾値{t}を超えています（{a}）。",
    "H106": "指示表現率が閾値{t}%を超えています（{a}%）。",
    "H107": "同一文頭labelが{a}文連続しています（閾値{t}）。",
    "H108": "同一文末labelが{a}文連続しています（閾値{t}）。",
    "H112": "段落の可視テキスト長が閾値{t}を超えています（{a}）。",
    "H113": "段落の文数が閾値{t}を超えています（{a}）。",
}
