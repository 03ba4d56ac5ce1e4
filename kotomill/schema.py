"""Column types of findings, reports and text structure. Offsets are UTF-16 units, half open."""

RANGE = "struct<start:int,end:int>"
FINDING = "struct<start:int,end:int,rule_id:string,category:string,severity:string,message:string,actual:int,threshold:int>"
SEMANTIC = "struct<ruleId:string,status:string,range:struct<start:int,end:int>,evidence:array<string>,reason:string,confidence:double,suggestedAction:string>"

# Identifiers of the rules and statuses of judgements.
DETERMINISTIC = ("D001", "D002", "D003", "D004", "D005", "D006", "D007", "D008")
HEURISTIC = ("H101", "H102", "H103", "H104", "H106", "H107", "H108", "H112", "H113")
SEMANTIC_RULES = ("S201", "S202", "S203", "S204", "S205", "S206", "S207", "S208")
STATUSES = ("violation", "no_violation", "uncertain")
