"""Fixed vocabularies shared by every job.

Everything here is a fixed value: class names, spellings, header aliases,
thresholds and guidance. The tables are small and closed (the longest has 25
entries), so they travel inside the plan as literals; nothing here grows with
the data.
"""

from __future__ import annotations

# Classes in declaration order; the position is the label code.
BENIGN, DOS, DDOS, PORT_SCAN, BOT = "Benign", "DoS", "DDoS", "PortScan", "Bot"
BRUTE_FORCE, WEB_ATTACK, INFILTRATION, UNKNOWN = (
    "BruteForce", "WebAttack", "Infiltration", "Unknown")
TRAINABLE = [BENIGN, DOS, DDOS, PORT_SCAN, BOT, BRUTE_FORCE, WEB_ATTACK, INFILTRATION]
ATTACK_TYPES = TRAINABLE + [UNKNOWN]
CODE_OF = {name: code for code, name in enumerate(TRAINABLE)}

# Severities from least to most urgent, and the base per class.
SEVERITY_ORDER = ["Low", "Medium", "High", "Critical"]
SEVERITY_OF = {
    BENIGN: "Low", DOS: "Critical", DDOS: "Critical", PORT_SCAN: "High", BOT: "High",
    BRUTE_FORCE: "High", WEB_ATTACK: "Medium", INFILTRATION: "Medium", UNKNOWN: "Low",
}
URGENT_SEVERITIES = ["Critical", "High"]

# Canonical feature space, in order.
FEATURES = ["flow_duration", "total_bytes", "total_packets", "avg_packet_size", "packet_rate"]
LABEL = "label"

# Label spellings of generic logs.
GENERIC_LABELS = {
    "benign": BENIGN, "normal": BENIGN, "clean": BENIGN, "background": BENIGN,
    "dos": DOS, "dos hulk": DOS, "dosgoldeneye": DOS, "dos hulk goldeneye": DOS,
    "ddos": DDOS, "distributed denial of service": DDOS,
    "portscan": PORT_SCAN, "port scan": PORT_SCAN, "scan": PORT_SCAN,
    "bot": BOT, "botnet": BOT,
    "bruteforce": BRUTE_FORCE, "brute force": BRUTE_FORCE, "bf": BRUTE_FORCE,
    "patator": BRUTE_FORCE,
    "webattack": WEB_ATTACK, "web attack": WEB_ATTACK, "xss": WEB_ATTACK,
    "sqli": WEB_ATTACK, "sql injection": WEB_ATTACK,
    "infiltration": INFILTRATION,
}

# Label spellings of benchmark captures.
CAPTURE_LABELS = {
    "benign": BENIGN,
    "dos hulk": DOS, "dos goldeneye": DOS, "goldeneye": DOS, "dos slowloris": DOS,
    "slowloris": DOS, "dos slowhttptest": DOS, "slowhttptest": DOS,
    "ddos": DDOS,
    "portscan": PORT_SCAN, "port scan": PORT_SCAN,
    "bot": BOT, "botnet ares": BOT,
    "brute force": BRUTE_FORCE, "ftp patator": BRUTE_FORCE, "ssh patator": BRUTE_FORCE,
    "web attack brute force": BRUTE_FORCE,
    "web attack": WEB_ATTACK, "web attack xss": WEB_ATTACK, "xss": WEB_ATTACK,
    "sql injection": WEB_ATTACK, "web attack sql injection": WEB_ATTACK,
    "infiltration": INFILTRATION,
}
EXCLUDED_CAPTURE_WORD = "heartbleed"

# Header aliases. Exact ones match a whole normalised header,
# contained ones match inside a longer header.
EXACT_ALIASES = {
    LABEL: ["label", "class", "classname", "attack", "attacktype", "category"],
    "flow_duration": ["flowduration", "flowdurations", "flowdurationus",
                      "flowdurationmicroseconds", "duration"],
    "total_bytes": ["bytes", "totalbytes", "totallength", "flowbytes",
                    "totalbytestransferred"],
    "total_packets": ["totalpackets", "packets", "packetcount"],
    "avg_packet_size": ["avgpacketsize", "avgpacketlen", "meanpacketsize", "packetsize",
                        "avglen"],
    "packet_rate": ["packetrate", "packetspersecond", "flowrate", "flowpacketspersecond"],
}
CONTAINED_ALIASES = {
    LABEL: ["attacktype", "category"],
    "flow_duration": ["flowduration", "flowdurations", "flowdurationus",
                      "flowdurationmicroseconds"],
    "total_bytes": ["totallength", "flowbytes", "totalbytestransferred"],
    "total_packets": ["totalpackets"],
    "avg_packet_size": ["avgpacketsize", "avgpacketlen", "meanpacketsize"],
    "packet_rate": ["packetspersecond", "flowpacketspersecond"],
}

# Capture columns and the headers they are read from.
CAPTURE_COLUMNS = {
    "flow_duration": ["Flow Duration", "flow_duration"],
    "fwd_packets": ["Total Fwd Packets", "Fwd Packets"],
    "bwd_packets": ["Total Backward Packets", "Bwd Packets"],
    "fwd_bytes": ["Total Length of Fwd Packets", "Fwd Packet Length Total"],
    "bwd_bytes": ["Total Length of Bwd Packets", "Bwd Packet Length Total"],
    "avg_packet_size": ["Average Packet Size", "Avg Packet Size"],
    "packet_rate": ["Flow Packets/s", "Flow Packets per Second"],
    "label": ["Label", "label"],
}
# Measurements in the order they are checked; the first problem names the row.
CAPTURE_MEASUREMENTS = ["flow_duration", "fwd_packets", "bwd_packets", "fwd_bytes",
                        "bwd_bytes", "avg_packet_size", "packet_rate"]

# Reason codes of rows left out of a training set.
MISSING_LABEL, HEARTBLEED, UNKNOWN_LABEL = (
    "missing_label", "heartbleed_excluded", "unknown_label")
MISSING_VALUE, UNPARSABLE_VALUE, NON_FINITE_VALUE, NON_FINITE_DERIVED = (
    "missing_value", "unparsable_value", "non_finite_value", "non_finite_derived_value")
EXCLUSION_CODES = [MISSING_LABEL, HEARTBLEED, UNKNOWN_LABEL, MISSING_VALUE,
                   UNPARSABLE_VALUE, NON_FINITE_VALUE, NON_FINITE_DERIVED]

# Thresholds and scores of the rules.
MEAN_BYTES_FLOOD = 1_000_000.0
PEAK_RATE_FLOOD = 1_000.0
SCAN_MIN_PACKETS = 20.0
SCAN_MAX_SIZE = 64.0
GUESS_MIN_ROWS = 10
GUESS_MAX_DURATION = 1_000_000.0
FLOOD_WEIGHT, SCAN_WEIGHT, GUESS_WEIGHT = 0.9, 0.8, 0.7
LABEL_CONFIDENCE, UNSURE_CONFIDENCE, BENIGN_CONFIDENCE = 0.99, 0.3, 0.7
AGREEMENT_BONUS, MAX_AGREEMENTS = 0.05, 2
LOW_CONFIDENCE = 0.5
MODEL_FLOOR = 0.5

# Stored enumerations.
UPLOAD_STATES = ["processing", "completed", "failed"]
AUDIT_ACTIONS = ["report.generated", "report.retrieved", "report.downloaded"]
ROLES = ["Viewer", "Analyst", "Admin"]
# Which roles may perform which audited action.
ACTION_ROLES = {
    "report.generated": ["Analyst", "Admin"],
    "report.retrieved": ["Viewer", "Analyst", "Admin"],
    "report.downloaded": ["Viewer", "Analyst", "Admin"],
}
EMAIL_PATTERN = (r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
                 r"(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+$")
EMAIL_MAX = 255
FILENAME_MAX = 255

# Limits of the reference behaviour.
UPLOAD_MAX_BYTES = 100 * 1024 * 1024
PREVIEW_ROWS = 5
LIMITER_LIMIT, LIMITER_WINDOW_SECONDS = 120, 60
DELIMITERS = [",", ";", "\t", "|"]

# What to do per class, as steps of incident handling: contain, then collect, then prevent.
GUIDANCE = {
    BENIGN: ["Close: no action."],
    DOS: ["Contain: drop or throttle the top talkers at the nearest router.",
          "Collect: packet samples and connection tables of the target."],
    DDOS: ["Contain: hand the prefix to the upstream scrubbing service.",
           "Collect: flow exports per ingress link.",
           "Prevent: put anycast or a delivery network in front of the service.",
           "Prevent: rehearse the hand-over."],
    PORT_SCAN: ["Collect: list of services that answered, with their versions.",
                "Prevent: default-deny rules between segments."],
    BOT: ["Contain: quarantine VLAN for the hosts; sinkhole the names they resolve.",
          "Collect: process lists and autostart entries.",
          "Recover: reinstall from a known image and reissue certificates and keys."],
    BRUTE_FORCE: ["Contain: lock the accounts under attack until their owners are reached.",
                  "Collect: authentication events around the burst, failures and successes."],
    WEB_ATTACK: ["Contain: virtual patch for the route in front of the application.",
                 "Collect: request bodies and the application's error log.",
                 "Recover: compare the data store with a backup taken before.",
                 "Prevent: bound parameters in every statement."],
    INFILTRATION: ["Contain: cut the segment from the internet, keep the hosts powered.",
                   "Collect: disk and memory images, directory service changes.",
                   "Recover: new credentials for everybody who logged on there."],
    UNKNOWN: ["Triage: an analyst assigns a class or marks the source as unusable."],
}
DEFAULT_GUIDANCE = ["Triage: the class has no entry in the response plan."]
ESCALATION_TEXT = "Page the duty officer (severity %s)."

# Technique ids per class from the public ATT&CK matrix.
TECHNIQUES = {
    DOS: ("T1499", "Endpoint Denial of Service"),
    DDOS: ("T1498", "Network Denial of Service"),
    PORT_SCAN: ("T1046", "Network Service Discovery"),
    BOT: ("T1071", "Application Layer Protocol"),
    BRUTE_FORCE: ("T1110", "Brute Force"),
    WEB_ATTACK: ("T1190", "Exploit Public-Facing Application"),
    INFILTRATION: ("T1133", "External Remote Services"),
}
