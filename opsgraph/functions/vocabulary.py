"""Word lists, codes and domains."""

# Results depend on them as they are.

NODE_TYPES = ["Equipment", "Component", "FailureMode", "WorkOrder", "Incident", "Procedure", "Permit", "RegulatoryClause", "Person", "Document", "Chunk", "TacitNote"]
EDGE_TYPES = ["CONNECTED_TO", "PART_OF", "PERFORMED_ON", "EXHIBITS", "HAS_CAUSE", "GOVERNS", "REQUIRES", "COVERS", "ISSUED_FOR", "MENTIONS", "EXTRACTED_FROM", "ABOUT", "OCCURRED_AT", "SAME_AS"]
#: Pairs of node types that an edge type joins, in order of preference.
EDGE_DOMAIN = {
    "CONNECTED_TO": [("Equipment", "Equipment")],
    "PART_OF": [("Component", "Equipment")],
    "PERFORMED_ON": [("WorkOrder", "Equipment")],
    "EXHIBITS": [("WorkOrder", "FailureMode"), ("Incident", "FailureMode")],
    "HAS_CAUSE": [("FailureMode", "Component"), ("FailureMode", "FailureMode")],
    "GOVERNS": [("Procedure", "Equipment")],
    "REQUIRES": [("Procedure", "RegulatoryClause")],
    "COVERS": [("RegulatoryClause", "Equipment")],
    "ISSUED_FOR": [("Permit", "Equipment")],
    "MENTIONS": [("Chunk", t) for t in NODE_TYPES],
    "EXTRACTED_FROM": [(t, "Document") for t in NODE_TYPES],
    "ABOUT": [("TacitNote", "Equipment"), ("TacitNote", "FailureMode")],
    "OCCURRED_AT": [("Incident", "Equipment")],
    "SAME_AS": [(t, t) for t in NODE_TYPES],
}
EQUIPMENT_PREFIXES = ["P", "V", "E", "FV", "PT", "T", "C", "LT", "TT", "FT", "PV", "LV", "TV"]
#: Failure rules in order of priority; a code may stand at more than one place.
FAILURE_RULES = [
    (r"\b(seal|seel)\b.*\b(leak|lkg|fail|leakage)\b|external leak", "ELP"),
    (r"internal leak", "INL"),
    (r"\bvib(ration|n)?\b", "VIB"),
    (r"overheat|over ?heating|high temp|hot bearing", "OHE"),
    (r"stuck|seiz(e|ed)|stiff|jam", "STU"),
    (r"chok(e|ed)|plug(ged)?|block(ed|age)", "PLU"),
    (r"abnormal (instrument )?reading|reading drift|drift|spurious", "AIR"),
    (r"noise|noisy", "NOI"),
    (r"wear|erosion", "WEO"),
    (r"fail(s|ed)? to start|won'?t start", "STD"),
    (r"breakdown|broke down", "BRD"),
    (r"\bleak(age)?\b|weep", "ELP"),
]
FAILURE_NAMES = {
    "ELP": "External leakage (process medium)", "INL": "Internal leakage", "VIB": "Vibration", "OHE": "Overheating", "NOI": "Noise", "STU": "Stuck / seized", "AIR": "Abnormal instrument reading",
    "STD": "Fails to start on demand", "BRD": "Breakdown", "PLU": "Plugged / choked", "WEO": "Wear / erosion",
}
COMPONENTS = ["mechanical seal", "seal", "bearing", "gland", "impeller", "gasket", "coupling", "actuator", "positioner", "tube", "relief valve"]
ANSWER_STOP = "the a an of to in on for and or is are was were be with at by from as what which who how why when where did do does has have had this that any all it its plant unit".split()
QUERY_STOP = [*ANSWER_STOP, "had", "a", "report"]
OBLIGATION_STOP = (
    "shall prior during before after obtain obtained obtaining displayed valid activity area areas work maintenance intrusive routine non-routine job jobs process equipment person persons personnel any all "
    "the and for with from that this these those into out any repeated defined until unless likely present wear worn made carried out place placed within during time times each other clause standard "
    "procedure applicable referenced scope demo synthetic text prepared official published not this is are be been being have has had will provided identify identified logged log entrant supervisor standby "
    "commence commenced commences step steps"
).split()
CRITICAL_TERMS = (
    "gas gases atmosphere atmospheric oxygen flammable toxic testing tested test fire watch lock locked tag tagged isolate isolated isolation blind blinded ventilate ventilation relief monitor monitored "
    "permit calibration inspection vibration lel h2s breathing"
).split()
GLOBAL_QUESTION = (
    r"\b(pattern|patterns|trend|trends|recur|recurr|across the|over the (last|past)|overall|in general|common|most frequent|summar|sensemak|five years|5 years|what.*(risks|failures).*(recur|common)|systemic)\b"
)
MULTIHOP_QUESTION = (
    r"\b(as well as|which .*\b(and|that)\b|related to|connected to|linked to|root cause|caused by|why did|leads? to|both .* and|downstream|upstream|preceded by|governed by)\b"
)
ENTITY_TYPES = ["Equipment", "FailureMode", "WorkOrder", "Incident", "Procedure", "RegulatoryClause", "TacitNote", "Component"]
CLAUSE_COVERED, CLAUSE_PARTIAL, CLAUSE_GENERAL = 0.5, 0.25, 0.3
PRECURSOR_DAYS, PATTERN_EVENTS, PRECURSOR_SHARE = 30, 3, 0.5
EMBEDDING_SIZE, CHUNK_CHARS, RRF_CONSTANT, PPR_DAMPING = 768, 700, 60, 0.85

#: The class of a drawing's symbol to the type of its equipment.
SYMBOL_TYPES = {"pump": "pump", "compressor": "compressor", "vessel": "vessel", "tank": "tank", "heat_exchanger": "heat exchanger", "valve": "control valve", "instrument": "instrument"}
