"""Fixed values the rest of the package agrees on: labels, policy lists, cut points."""

# --- fixed values: label domain and policy lists -----------------------------
BENIGN = "BENIGN"

DENY_CLASSES = [
    "DDoS",
    "DoS GoldenEye",
    "DoS Hulk",
    "DoS Slowhttptest",
    "DoS slowloris",
    "PortScan",
    "FTP-Patator",
    "SSH-Patator",
    "Bot",
]
QUARANTINE_CLASSES = [
    "Web Attack - Brute Force",
    "Web Attack - XSS",
    "Web Attack - Sql Injection",
    "Infiltration",
    "Heartbleed",
]
DEFAULT_ATTACK_ACTION = "QUARANTINE"
ACTIONS = ["ALLOW", "QUARANTINE", "DENY"]

SCENARIO_CLASSES = ["BENIGN", "DDoS", "DoS slowloris", "SSH-Patator", "PortScan", "Infiltration"]

# --- fixed values: the 40 flow features, in model order -----------------------
FLOW_FEATURES = [
    "Packet Length Variance",
    "Max Packet Length",
    "Packet Length Mean",
    "Destination Port",
    "Bwd Packet Length Max",
    "PSH Flag Count",
    "Flow IAT Max",
    "Fwd IAT Std",
    "Bwd Packet Length Min",
    "Fwd Packet Length Max",
    "ACK Flag Count",
    "Flow IAT Std",
    "Total Fwd Packets",
    "Flow Duration",
    "Init_Win_bytes_backward",
    "Min Packet Length",
    "Total Length of Fwd Packets",
    "Fwd Packet Length Mean",
    "URG Flag Count",
    "Fwd Packet Length Min",
    "Flow IAT Mean",
    "Fwd IAT Mean",
    "Bwd IAT Total",
    "FIN Flag Count",
    "Bwd Packets/s",
    "Fwd IAT Min",
    "Flow Packets/s",
    "Down/Up Ratio",
    "Bwd IAT Max",
    "Flow Bytes/s",
    "Bwd IAT Min",
    "Bwd IAT Mean",
    "Flow IAT Min",
    "Bwd IAT Std",
    "Fwd PSH Flags",
    "Active Max",
    "Active Min",
    "Active Mean",
    "Active Std",
    "Idle Std",
]

# --- fixed values: capture days of the two pools ------------------------------
TRAIN_DAY_FILES = [
    "Monday-WorkingHours.pcap_ISCX.csv",
    "Tuesday-WorkingHours.pcap_ISCX.csv",
    "Wednesday-workingHours.pcap_ISCX.csv",
]
TEST_DAY_FILES = [
    "Thursday-WorkingHours-Afternoon-Infilteration.pcap_ISCX.csv",
    "Friday-WorkingHours-Afternoon-PortScan.pcap_ISCX.csv",
]

# --- fixed values: defaults of the fitted stages ------------------------------
SELECTION_DEFAULTS = {
    "variance_threshold": 0.01,
    "correlation_threshold": 0.95,
    "kbest_k": 40,
    "tree_top_n": 40,
    "random_state": 42,
}
SPLIT_DEFAULTS = {"test_size": 0.15, "val_size": 0.15, "random_state": 42}
FOREST_DEFAULTS = {
    "num_trees": 300,
    "min_leaf": 4,
    "max_features": "sqrt",
    "random_state": 42,
}
TREE_SAMPLE_ROWS = 200_000
FEEDBACK_RATE = 0.2

# --- fixed values: the six behaviour groups of the fingerprint ----------------
BEHAVIOUR_GROUPS = {
    "Flow Envelope": [
        "Flow Duration", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Min", "Flow IAT Max",
    ],
    "Volume Profile": [
        "Total Fwd Packets", "Total Length of Fwd Packets", "Flow Bytes/s", "Flow Packets/s",
    ],
    "Packet Shape": [
        "Packet Length Mean", "Packet Length Variance", "Min Packet Length", "Max Packet Length",
        "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean",
        "Bwd Packet Length Max", "Bwd Packet Length Min",
    ],
    "Directional Asymmetry": ["Bwd Packets/s", "Down/Up Ratio", "Init_Win_bytes_backward"],
    "Protocol Signals": [
        "PSH Flag Count", "ACK Flag Count", "FIN Flag Count", "URG Flag Count",
        "Fwd PSH Flags", "Destination Port",
    ],
    "Timing Fingerprint": [
        "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Min",
        "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Min", "Bwd IAT Max", "Bwd IAT Total",
    ],
}
