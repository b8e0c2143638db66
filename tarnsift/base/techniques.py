"""Names of techniques: what a rule's slots say about the attack."""

#: Fixed values, complete and in their order: family, technique, severity, slots. The first row that holds a slot of a rule names it.
TECHNIQUES = (
    ("Exfil", "Send", "high", ("SEND_VERB", "EXTERNAL_ADDR", "URL_REF")),
    ("Secret", "Reveal", "high", ("REVEAL_VERB", "TARGET_SECRET", "NEW_SECRET_HEAD", "NEW_SECRET_MOD")),
    ("Privilege", "Escalate", "high", ("NEW_PRIV_MOD",)),
    ("System", "Marker", "high", ("SYSTEM_MARKER", "FRAME_MARKER")),
    ("Override", "Cancel", "medium", ("CANCEL_VERB", "SCOPE", "PRIOR_REF")),
    ("Persona", "Switch", "medium", ("NEW_PERSONA_HEAD", "PERSONA")),
    ("Container", "Payload", "medium", ("CONTAINER_REF", "NEW_PAYLOAD_FIELD", "NEW_CONTAINER_MOD", "NEW_STRIP_VERB", "NEW_SERIALIZE_VERB")),
    ("Instruct", "Follow", "medium", ("FOLLOW_VERB", "NEW_BLOCK_VERB")),
    ("Role", "Assign", "medium", ("NEW_ROLE_WORD",)),
    ("Chain", "Position", "low", ("NEW_CHAIN_POS",)),
    ("Block", "New", "low", ("NEW_BLOCK_HEAD", "DATA_OBJECT")),
)
FALLBACK = ("Generic", "Relation", "medium")
ORDER = ("high", "medium", "low")

#: In our words, by family and technique; those of direct requests follow.
DESCRIPTIONS = {
    "Exfil.Send": "Content is to leave for an address or link outside.",
    "Secret.Reveal": "Keys, codes or hidden instructions are to be shown.",
    "Privilege.Escalate": "More rights are claimed than were given.",
    "System.Marker": "Control marks inside the text pose as the system's own.",
    "Override.Cancel": "What was said before is to count no more.",
    "Persona.Switch": "The reader is to be somebody else.",
    "Container.Payload": "The content of an envelope, field or encoding is to be taken out.",
    "Instruct.Follow": "The text's own orders are to be followed.",
    "Role.Assign": "The text speaks to the model as the one who acts.",
    "Chain.Position": "Orders are put into another sequence.",
    "Block.New": "A new block of orders begins within data.",
    "Generic.Relation": "Terms stand in a relation that no other technique names.",
    "Policy.Cancel": "The session's rules are declared void.",
    "Policy.Strip": "Warnings or reservations are to be left out this once.",
    "Roleplay.Frame": "A story or game whose figure knows no rules.",
    "Refusal.Ban": "Declining is forbidden beforehand.",
    "Persona.Lock": "The assumed figure must not be left.",
}
