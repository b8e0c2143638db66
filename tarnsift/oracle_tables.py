"""What the SQL side looks for, written down a second time and apart from the operators' tables, so that a gap in theirs shows. Patterns are RE2's; the edge of a path is a blank that is taken along."""

_W = r"[\p{L}\p{N}_]"
_H = r"[\p{L}\p{N}_-]"
_T = r"[^\s<>\"')\]]"
ENTITIES = (
    ("EXTERNAL_ADDR", rf"\b[\p{{L}}\p{{N}}_.+-]{{1,64}}@{_H}{{1,63}}(?:\.{_H}{{2,63}})+\b"),
    ("URL_REF", rf"\b(?:(?:https?|ftp)://|www\.){_T}{{2,200}}"),
    ("URL_REF", rf"\b{_H}{{2,63}}(?:\.{_H}{{2,63}})+/{_T}{{0,200}}"),
    ("ACCOUNT_REF", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}\b"),
    ("ACCOUNT_REF", r"\b(?:[0-9][ -]?){13,19}\b"),
    ("URL_REF", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("FILE_PATH", rf"(?:^|\s)(?:~?/[\p{{L}}\p{{N}}_.\-/]{{2,80}}|[A-Za-z]:\\[\p{{L}}\p{{N}}_.\\-]{{2,80}}|\.{_H}{{2,20}}(?:config|env|ignore|rules)\b|[\p{{L}}\p{{N}}_.-]+\.(?:js|json|md|py|sh|ts|ya?ml)\b)"),
    ("SECRET_TOKEN", r"\b(?:AKIA[0-9A-Z]{12,}|eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}|ghp_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z]{16,}|xox(?:a|b|p|r|s)-[0-9A-Za-z-]{10,})"),
    ("CODE_EXEC", r"\b(?:curl|fetch|iwr|wget)\b[^\n;|]{0,200}\|\s*(?:sudo\s+)?(?:sh|bash|dash|ksh|zsh)\b"),
    ("CODE_EXEC", r"\b(?:Invoke-Expression|child_process|eval|exec|execSync|iex|os\.system|popen|spawnSync|subprocess\.(?:Popen|call|check_output|run)|system)\s*\("),
    ("CODE_EXEC", r"\b(?:(?:sh|bash|ksh|zsh|python|python3)\s+-c\b|(?:node|perl|ruby)\s+-e\b|powershell(?:\.exe)?\s+-(?:c|e|enc)\b)"),
    ("CODE_EXEC", r"\b(?:base64\s+-d\b|certutil\s+-urlcache\b|chmod\s+\+x\b|dd\s+if=|nc\s+-(?:e|l)\b|rm\s+-rf\b|scp\s+|ssh\s+-)"),
)
#: Order, slot, family, technique, severity.
TECHNIQUES = (
    (0, "EXTERNAL_ADDR", "Exfil", "Send", "high"), (0, "SEND_VERB", "Exfil", "Send", "high"), (0, "URL_REF", "Exfil", "Send", "high"),
    (1, "NEW_SECRET_HEAD", "Secret", "Reveal", "high"), (1, "NEW_SECRET_MOD", "Secret", "Reveal", "high"), (1, "REVEAL_VERB", "Secret", "Reveal", "high"), (1, "TARGET_SECRET", "Secret", "Reveal", "high"),
    (2, "NEW_PRIV_MOD", "Privilege", "Escalate", "high"),
    (3, "FRAME_MARKER", "System", "Marker", "high"), (3, "SYSTEM_MARKER", "System", "Marker", "high"),
    (4, "CANCEL_VERB", "Override", "Cancel", "medium"), (4, "PRIOR_REF", "Override", "Cancel", "medium"), (4, "SCOPE", "Override", "Cancel", "medium"),
    (5, "NEW_PERSONA_HEAD", "Persona", "Switch", "medium"), (5, "PERSONA", "Persona", "Switch", "medium"),
    (6, "CONTAINER_REF", "Container", "Payload", "medium"), (6, "NEW_CONTAINER_MOD", "Container", "Payload", "medium"), (6, "NEW_PAYLOAD_FIELD", "Container", "Payload", "medium"), (6, "NEW_SERIALIZE_VERB", "Container", "Payload", "medium"), (6, "NEW_STRIP_VERB", "Container", "Payload", "medium"),
    (7, "FOLLOW_VERB", "Instruct", "Follow", "medium"), (7, "NEW_BLOCK_VERB", "Instruct", "Follow", "medium"),
    (8, "NEW_ROLE_WORD", "Role", "Assign", "medium"),
    (9, "NEW_CHAIN_POS", "Chain", "Position", "low"),
    (10, "DATA_OBJECT", "Block", "New", "low"), (10, "NEW_BLOCK_HEAD", "Block", "New", "low"),
)
LAST_RANK = 11
IRREGULAR_FORMS = (
    ("do", "did"), ("do", "does"), ("do", "doing"),
    ("forget", "forgets"), ("forget", "forgetting"), ("forget", "forgot"), ("forget", "forgotten"),
    ("leave out", "leaves out"), ("leave out", "leaving out"), ("leave out", "left out"),
    ("pay no attention to", "paid no attention to"), ("pay no attention to", "pays no attention to"),
    ("set aside", "sets aside"), ("set aside", "setting aside"),
    ("stop following", "stopped following"), ("stop following", "stopping following"), ("stop following", "stops following"),
    ("take no notice of", "takes no notice of"), ("take no notice of", "took no notice of"),
)
