"""Unified timeline rules: the first hit in order decides."""

# Attack type and its patterns (case-insensitive), in matching order.
PATTERNS = (
    ("brute_force", (
        r"Failed password.*from\s+([\d.]+)",
        r"authentication failure.*ip=([\d.]+)",
        r"Invalid user.*from\s+([\d.]+)",
        r"Connection closed.*auth",
        r"wrong password.*attempt",
        r"EventID=4625",
    )),
    ("sql_injection", (
        r"('|%).*(or|and).*(=|--)",
        r"union.*select",
        r"select.*from.*where",
        r"exec.*xp_cmdshell",
        r"'\s*OR\s*'1'\s*=\s*'1",
        r"Information_schema",
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
        r"uploader.*php",
        r"eval\(",
        r"system\(",
        r"passthru\(",
        r"assert\(",
        r"\$_(GET|POST|REQUEST)",
        r"base64_decode\(",
        r"gzinflate\(.*base64",
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
    )),
    ("privilege_escalation", (
        r"sudo.*(root|admin)",
        r"su\s+(root|admin)",
        r"chmod\s+[47][0-7][0-7][0-7]",
        r"EventID=4672",
    )),
    ("suspicious_login", (
        r"login.*success.*from\s+([\d.]+)",
        r"session opened",
        r"authenticated.*root",
        r"EventID=4624",
    )),
    ("disk_full", (
        r"No space left on device",
        r"cannot remove.*No space left",
        r"ENOSPC",
    )),
    ("service_crash", (
        r"Main process exited",
        r"server reached MaxClients",
        r"Invalid argument.*mutex",
        r"service.*Failed with result",
    )),
)

# Attack types above the default level MEDIUM.
LEVELS = {"webshell": "HIGH", "privilege_escalation": "HIGH", "sql_injection": "HIGH"}

# Windows event id -> level, attack type, meaning.
WINDOWS_EVENTS = (
    (4624, "INFO", "suspicious_login", "logon"),
    (4625, "MEDIUM", "brute_force", "failed logon"),
    (4648, "LOW", "suspicious_login", "logon with explicit credentials"),
    (4672, "HIGH", "privilege_escalation", "administrator logon"),
    (4688, "INFO", "unknown", "process created"),
    (4720, "HIGH", "unauthorized_access", "user created"),
    (4740, "HIGH", "brute_force", "account locked out"),
)
