"""Timeline rules: the first hit in order decides."""

# Attack type and its patterns (case-insensitive), in matching order.
PATTERNS = (
    ("brute_force", (
        r"Failed password.*from\s+([\d.]+)",
        r"authentication failure.*ip=([\d.]+)",
        r"Invalid user.*from\s+([\d.]+)",
        r"Connection closed.*auth",
        r"wrong password.*attempt",
        r"Failed.*ssh.*[0-9]{1,3}\.[0-9]{1,3}",
    )),
    ("sql_injection", (
        r"('|%).*(or|and).*(=|--)",
        r"union.*select",
        r"select.*from.*where",
        r"exec.*xp_cmdshell",
        r"Information_schema",
        r"'\s*OR\s*'1'\s*=\s*'1",
    )),
    ("xss", (
        r"<script>",
        r"javascript:",
        r"onerror=",
        r"onload=",
        r"alert\(",
        r"document\.cookie",
    )),
    ("webshell", (
        r"cmd\.php",
        r"shell\.php",
        r"eval\(",
        r"system\(",
        r"passthru\(",
        r"assert\(",
        r"\$_(GET|POST|REQUEST)\[",
        r"base64_decode\(",
    )),
    ("file_upload", (
        r"\.php.*upload",
        r"\.asp.*upload",
        r"\.jsp.*upload",
        r"\.exe.*upload",
        r"uploader.*php",
    )),
    ("path_traversal", (
        r"\.\./",
        r"""\.\.\\""",
        r"%2e%2e",
        r"\.\.%2f",
        r"etc/passwd",
        r"boot\.ini",
    )),
    ("command_injection", (
        r";\s*(cat|ls|wget|curl|nc)",
        r"\|(cat|ls|wget|curl|nc)",
        r"`.*(cat|ls|wget|curl|nc)",
        r"\$(cat|ls|wget|curl|nc)",
    )),
    ("privilege_escalation", (
        r"sudo.*(root|admin)",
        r"su\s+(root|admin)",
        r"chmod\s+[47][0-7][0-7][0-7]",
        r"chown.*root.*root",
    )),
    ("port_scan", (
        r"Connect.*port\s+[0-9]+",
        r"Port.*scan",
        r"nmap",
        r"masscan",
        r"connect from.*port",
    )),
    ("suspicious_login", (
        r"login.*success.*from\s+([\d.]+)",
        r"session opened",
        r"authenticated.*root",
        r"ssh.*[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    )),
)

# Attack types above the default level MEDIUM.
LEVELS = {"webshell": "HIGH", "privilege_escalation": "HIGH", "sql_injection": "HIGH", "xss": "HIGH"}

# Windows event id -> level, attack type, meaning.
WINDOWS_EVENTS = (
    (4624, "INFO", "suspicious_login", "logon"),
    (4625, "MEDIUM", "brute_force", "failed logon"),
    (4648, "LOW", "suspicious_login", "logon with explicit credentials"),
    (4672, "HIGH", "privilege_escalation", "administrator logon"),
    (4688, "INFO", "unknown", "process created"),
    (4689, "INFO", "unknown", "process ended"),
    (4720, "HIGH", "unauthorized_access", "user created"),
    (4722, "HIGH", "unauthorized_access", "user enabled"),
    (4724, "HIGH", "unauthorized_access", "password reset"),
    (4725, "MEDIUM", "unauthorized_access", "user disabled"),
    (4726, "HIGH", "unauthorized_access", "user deleted"),
    (4733, "HIGH", "unauthorized_access", "member removed from group"),
    (4735, "HIGH", "unauthorized_access", "group changed"),
    (4740, "HIGH", "brute_force", "account locked out"),
    (4756, "HIGH", "unauthorized_access", "member added to universal group"),
    (4964, "HIGH", "privilege_escalation", "special group logon"),
)
