"""Line rules, multi-match: every rule that hits yields one event."""

# Rule id, category, level, technique, confidence, pattern (case-insensitive).
RULES = (
    ("WEBSHELL_EVAL_ASSERT", "webshell", "CRITICAL", "T1505", 0.8,
     r"""\$\w+\s*=\s*[\'"]?(eval|assert|system)"""),
    ("WEBSHELL_BASE64", "webshell", "CRITICAL", "T1505", 0.8,
     r"eval\s*\(\s*base64_decode"),
    ("WEBSHELL_FILENAME", "webshell", "CRITICAL", "T1505", 0.8,
     r"shell\.php|cmd\.php|backdoor\.php"),
    ("LOG4J_JNDI", "log4j", "CRITICAL", "T1190", 0.8,
     r"\$\{jndi:(ldap|rmi|dns):\/\/"),
    ("LOG4J_RCE", "log4j", "CRITICAL", "T1190", 0.8,
     r"Loaded remote class.*jndi"),
    ("SQLI_BASIC", "sql_injection", "HIGH", "T1190", 0.8,
     r"('|%).*(or|and).*(=|--)"),
    ("SQLI_UNION", "sql_injection", "CRITICAL", "T1190", 0.8,
     r"(union.*select|UNION SELECT)"),
    ("XSS_SCRIPT", "xss", "HIGH", "T1190", 0.8,
     r"(<script|</script>)"),
    ("CMD_INJECTION", "command_injection", "HIGH", "T1059", 0.8,
     r"[;\|\$`\\]"),
    ("CMD_REVERSE_SHELL", "command_injection", "CRITICAL", "T1059", 0.8,
     r"(bash\s+-i|sh\s+-i|nc\s+-e|/bin/sh)"),
    ("PATH_TRAVERSAL", "path_traversal", "HIGH", "T1190", 0.8,
     r"(\.\./|\.\.\\)"),
    ("SENSITIVE_FILE_ACCESS", "path_traversal", "CRITICAL", "T1190", 0.8,
     r"(/etc/passwd|/boot.ini|win.ini)"),
    ("SSH_AUTH_FAILURE", "brute_force", "MEDIUM", "T1110", 0.8,
     r"Failed password for|Invalid user"),
    ("PERSISTENCE_REGISTRY", "persistence", "HIGH", "T1547", 0.8,
     r"Registry value was modified.*Run"),
    ("PERSISTENCE_TASK", "persistence", "HIGH", "T1053", 0.8,
     r"Task Scheduler.*Created task.*WindowsUpdater"),
    ("LATERAL_PSEXEC", "lateral_movement", "HIGH", "T1021", 0.8,
     r"PsExec"),
    ("LATERAL_WMI", "lateral_movement", "CRITICAL", "T1047", 0.8,
     r"wmic.*node.*process call create"),
    ("CRED_LSASS", "credential_theft", "CRITICAL", "T1003", 0.8,
     r"lsass.*procs|SeDebugPrivilege"),
    ("CRED_DCSYNC", "credential_theft", "CRITICAL", "T1003", 0.8,
     r"GetChanges.*DCSync|DCSync"),
    ("EVASION_POWERSHELL", "malware", "CRITICAL", "T1027", 0.8,
     r"-enc\s+SQBFAFg|powershell.*-encodedCommand"),
    ("EVASION_EDR", "malware", "CRITICAL", "T1562", 0.8,
     r"DisableAntiSpyware|DisableAntiVirus"),
    ("EVASION_LOGCLEAR", "malware", "CRITICAL", "T1070", 0.8,
     r"event log was cleared|wevtutil.*clear"),
)
