"""Names, codes and default settings that results depend on."""

# Attack names and their integer codes.
ATTACK_CODES = {
    "Normal": 0,
    "Generic": 1,
    "Exploits": 2,
    "Fuzzers": 3,
    "DoS": 4,
    "Reconnaissance": 5,
    "Analysis": 6,
    "Backdoor": 7,
    "Shellcode": 8,
    "Worms": 9,
}

# The prepared table's feature columns, in order, with their types.
FEATURE_TYPES = {
    "dur": "double", "proto": "string", "service": "string", "state": "string",
    "spkts": "long", "dpkts": "long", "sbytes": "long", "dbytes": "long",
    "rate": "double", "sttl": "long", "dttl": "long", "sload": "double",
    "dload": "double", "sloss": "long", "dloss": "long", "sinpkt": "double",
    "dinpkt": "double", "sjit": "double", "djit": "double", "swin": "long",
    "stcpb": "long", "dtcpb": "long", "dwin": "long", "tcprtt": "double",
    "synack": "double", "ackdat": "double", "smean": "long", "dmean": "long",
    "trans_depth": "long", "response_body_len": "long", "ct_srv_src": "int",
    "ct_state_ttl": "int", "ct_dst_ltm": "int", "ct_src_dport_ltm": "int",
    "ct_dst_sport_ltm": "int", "ct_dst_src_ltm": "int", "ct_flw_http_mthd": "int",
    "ct_src_ltm": "int", "ct_srv_dst": "int", "is_sm_ips_ports": "int",
}
FEATURES = list(FEATURE_TYPES)

# Categorical columns and the sentinel for an unknown service.
CATEGORICALS = ["proto", "service", "state"]
SERVICE_SENTINEL = "-"
SERVICE_UNKNOWN = "unknown"

# Columns dropped when present, per preparation flavour.
DROP_ONLINE = ["id", "attack_cat", "is_sm_ips_ports", "ct_ftp_cmd"]
DROP_OFFLINE = ["id", "label", "stime", "ltime", "srcip", "dstip", "is_ftp_login", "ct_ftp_cmd"]

# Rare classes, what they merge into, and the two-class subset.
RARE_CLASSES = [6, 7, 8, 9]
RARE_TARGET = 6
TWO_CLASSES = [0, 3]

# Name fragments that route a column to a semantic group.
STATIC_FRAGMENTS = ["bytes", "pkts", "rate"]
DYNAMIC_FRAGMENTS = ["dur", "jit", "pkt", "tt"]

# Name fragments of the reordering blocks, in block order.
ORDER_BLOCKS = [
    ["bytes", "pkts", "rate"],
    ["dur", "jit", "pkt"],
    ["tcp", "ack", "syn"],
    ["ct_"],
]

# The hand-listed grouping.
LISTED_STATIC = [
    "spkts", "dpkts", "sbytes", "dbytes", "rate", "sttl", "dttl", "sload", "dload",
    "sloss", "dloss", "smean", "dmean", "ct_srv_src", "ct_srv_dst", "ct_dst_ltm",
    "ct_src_ltm",
]
LISTED_DYNAMIC = [
    "dur", "sinpkt", "dinpkt", "sjit", "djit", "tcprtt", "synack", "ackdat",
    "trans_depth", "response_body_len", "ct_state_ttl", "ct_dst_src_ltm",
]

# Tokens a CSV cell may hold to mean "missing".
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Default settings.
SEED = 42
BATCH_SIZE = 64
LEARNING_RATE = 0.001
EPOCHS = 20
CLASS_CAP = 15_000
NORMAL_CAP = 20_000
ATTACK_CAP = 5_000
CORRELATION_THRESHOLD = 0.1
HOLDOUT_FRACTION = {"binary": 0.2, "multi": 0.3}
TASK2_FRACTION = 0.8
REPLAY_PER_CLASS = 200
REPLAY_DRAW = 16
FIFO_CAPACITY = 5_000
INTAKE_ROWS = 64
CLIENTS = 5
ROUNDS = 20
LOCAL_EPOCHS = 3
TEMPERATURE = 2.0
EWC_WEIGHT = 0.05
LWF_WEIGHT = 0.1
DECOUPLE_WEIGHT = 0.05
DECOUPLE_WARMUP = 0.3
FOCAL_GAMMA = 2.0
SUPPRESSED_CLASS = 3
SUPPRESSED_FACTOR = 0.5
THRESHOLD_GRID = [k / 100.0 for k in range(10, 91)]
DEFAULT_THRESHOLD = 0.5
RAISED_THRESHOLD = 0.6
SEQUENCE_STEPS = 10

# Our own choice: confidence and bucket count of the adaptive-window detector.
DRIFT_DELTA = 0.002
DRIFT_BUCKETS = 5

MODES = ("binary", "multi")


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError("mode must be 'binary' or 'multi'")
    return mode
