"""Small lookup tables."""

# Known addresses.
IP_REPUTATION = (
    ("185.220.101.46", "malicious", ("tor", "exit-node")),
    ("23.129.64.213", "malicious", ("tor", "exit-node")),
    ("45.154.255.147", "malicious", ("brute-force", "scanner")),
    ("91.121.87.18", "suspicious", ("scan",)),
)

# Private address ranges.
PRIVATE_RANGES = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8")

# Failed logins that raise an alert, that lock an account, and the minutes they fall in.
BRUTE_FORCE_FAILURES = 5
BRUTE_FORCE_LOCKOUT = 10
BRUTE_FORCE_MINUTES = 5

# What to do about an event, by category.
REMEDIATION = (
    ("webshell", "isolate the file and analyse what it can do"),
    ("log4j", "upgrade the logging library and block lookups"),
    ("sql_injection", "review the application firewall log and check for leaked data"),
    ("xss", "send a content security policy and review output encoding"),
    ("command_injection", "check input validation and disable dangerous functions"),
    ("path_traversal", "review file access control"),
    ("brute_force", "lock accounts and review the login log"),
    ("persistence", "check start-up entries and scheduled tasks"),
    ("lateral_movement", "isolate the hosts and review their connections"),
    ("credential_theft", "reset passwords and check the domain controllers"),
    ("malware", "isolate the host and analyse the program"),
)
REMEDIATION_DEFAULT = "review the security log"

# Advice by report: category, events that must be exceeded, severity, text.
ADVICE_EVENTS = (
    ("log4j", 0, "URGENT", "lookup injection found: upgrade the logging library now"),
    ("webshell", 0, "URGENT", "web shell found: isolate the servers"),
    ("credential_theft", 0, "SEVERE", "credential theft found: reset passwords, check domain controllers"),
    ("persistence", 0, "WARNING", "persistence found: scan the systems"),
    ("lateral_movement", 0, "WARNING", "lateral movement found: isolate the network segment"),
)
ADVICE_INCIDENTS = (
    ("brute_force", 5, "HIGH", "block the sources, lock accounts, require a second factor"),
    ("sql_injection", 0, "CRITICAL", "review firewall, database audit log and input validation"),
    ("webshell", 0, "CRITICAL", "isolate the files, review upload functions and the web root"),
    ("privilege_escalation", 0, "HIGH", "review sudo use, new users and file permissions"),
    ("data_exfiltration", 0, "CRITICAL", "isolate the systems, review transfers and outgoing traffic"),
    ("ransomware", 0, "CRITICAL", "isolate all affected systems, start recovery, check backups"),
)
ADVICE_TIMELINE = (
    ("brute_force", 10, "HIGH", "many login attempts: block the sources, require a second factor"),
    ("sql_injection", 0, "HIGH", "sql injection: review firewall rules and input validation"),
    ("webshell", 0, "SEVERE", "web shell traces: isolate the servers and scan their files"),
    ("privilege_escalation", 0, "SEVERE", "privilege escalation: review permissions and sudo use"),
    ("suspicious_login", 5, "MEDIUM", "suspicious logins: check places and times, end the sessions"),
)
ADVICE_UNIFIED = (
    ("brute_force", 5, "HIGH", "many login attempts: block the sources, require a second factor"),
    ("sql_injection", 0, "HIGH", "sql injection: review firewall rules and input validation"),
    ("webshell", 0, "SEVERE", "web shell traces: scan the web folders and isolate the servers"),
    ("suspicious_files", 0, "SEVERE", "suspicious files: isolate, keep evidence, remove"),
    ("critical_files", 0, "VERY_HIGH", "web shells of high confidence: start incident response"),
)
ADVICE_NONE = {
    "events": "keep the rules up to date",
    "incidents": None,
    "timeline": "no serious threat found; keep auditing the logs",
    "unified": "no serious threat found; keep auditing logs and files",
}

# Category -> stage of an attack chain.
CHAIN_STAGES = (
    ("brute_force", "initial_access"),
    ("sql_injection", "initial_access"),
    ("privilege_escalation", "privilege_escalation"),
    ("lateral_movement", "lateral_movement"),
    ("data_exfiltration", "exfiltration"),
)
