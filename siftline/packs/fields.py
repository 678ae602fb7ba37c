"""Field rules: a rule hits when any of its field patterns hits."""

# File, rule name, severity, category, technique, confidence, {field: pattern}.
RULES = (
    ("brute_force", "SSH - Failed Password", "medium", "brute_force", "T1110", 1.0, {
        "url": r"Failed password for",
    }),
    ("brute_force", "SSH - Invalid User", "medium", "brute_force", "T1110", 1.0, {
        "url": r"Invalid user",
    }),
    ("brute_force", "SSH - PAM Auth Failure", "medium", "brute_force", "T1110", 0.9, {
        "url": r"authentication failure.*ip=",
    }),
    ("brute_force", "HTTP - Login Brute Force", "medium", "brute_force", "T1110", 0.7, {
        "url": r"(login|signin|auth|admin).*401|403",
        "http_status": r"[4][0-9][0-9]",
    }),
    ("brute_force", "SSH - Pre-auth Disconnect", "low", "brute_force", "T1110", 0.7, {
        "url": r"Connection closed by.*port.*\[preauth\]",
    }),
    ("brute_force", "Windows - Login Failure", "medium", "brute_force", "T1110", 1.0, {
        "url": r"EventID=4625",
    }),
    ("log4j", "Log4Shell - JNDI LDAP", "critical", "log4j", "T1190", 1.0, {
        "url": r"\$\{jndi:ldap",
    }),
    ("log4j", "Log4Shell - JNDI RMI", "critical", "log4j", "T1190", 1.0, {
        "url": r"\$\{jndi:rmi",
    }),
    ("log4j", "Log4Shell - JNDI DNS", "critical", "log4j", "T1190", 0.95, {
        "url": r"\$\{jndi:dns",
    }),
    ("log4j", "Log4Shell - Remote Class Loading", "critical", "log4j", "T1190", 1.0, {
        "url": r"Loaded remote class|ClassNotFoundException",
    }),
    ("path_traversal", "Path Traversal - Basic", "high", "path_traversal", "T1190", 0.8, {
        "url": r"(\.\./|\.\.\\)",
    }),
    ("path_traversal", "Path Traversal - Double Encoding", "high", "path_traversal", "T1190", 0.9, {
        "url": r"(\%2e\%2e/|\%2e\%2e\\)",
    }),
    ("path_traversal", "Path Traversal - Unicode", "high", "path_traversal", "T1190", 0.85, {
        "url": r"(\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4})",
    }),
    ("path_traversal", "Path Traversal - Sensitive Files", "critical", "path_traversal", "T1190", 0.95, {
        "url": r"(/etc/passwd|/boot.ini|/win.ini|\.\./\.\./\.\./etc)",
    }),
    ("path_traversal", "Path Traversal - Config Files", "critical", "path_traversal", "T1190", 0.95, {
        "url": r"(/\.env|/config\.php|/wp-config\.php|/application\.properties)",
    }),
    ("rce", "RCE - Command Injection Characters", "high", "command_injection", "T1059", 0.7, {
        "url": r"[;|\$`\\]",
    }),
    ("rce", "RCE - System Function", "critical", "command_injection", "T1059", 0.95, {
        "url": r"system\(|shell_exec\(|exec\(|passthru\(|proc_open\(|popen\(",
    }),
    ("rce", "RCE - Python OS Module", "critical", "command_injection", "T1059", 0.9, {
        "url": r"os\.system|subprocess|eval\(.*request",
    }),
    ("rce", "RCE - Reverse Shell", "critical", "command_injection", "T1059", 0.95, {
        "url": r"bash\s+-i|sh\s+-i|nc\s+-e|/bin/sh",
    }),
    ("sql_injection", "SQL Injection - Basic", "high", "injection", "T1190", 0.8, {
        "url": r"('|%27|%25).*(or|and).*(=|%3D|--|%2D%2D)",
    }),
    ("sql_injection", "SQL Injection - UNION SELECT", "critical", "injection", "T1190", 0.95, {
        "url": r"union.*select|union all select",
    }),
    ("sql_injection", "SQL Injection - Error Based", "high", "injection", "T1190", 0.9, {
        "url": r"mysql.*error|oracle.*error|mssql.*error|postgresql.*error",
    }),
    ("sql_injection", "SQL Injection - Time Based", "high", "injection", "T1190", 0.85, {
        "url": r"sleep|benchmark|pg_sleep",
    }),
    ("sql_injection", "SQL Injection - xp_cmdshell", "critical", "injection", "T1190", 0.95, {
        "url": r"xp_cmdshell|sp_executesql|declare\s+@|set\s+@",
    }),
    ("webshell", "WebShell - Eval", "critical", "webshell", "T1505", 0.95, {
        "url": r"\$\w+.*=.*eval|@eval",
    }),
    ("webshell", "WebShell - Base64", "critical", "webshell", "T1505", 0.9, {
        "url": r"eval\(gzinflate\(base64_decode",
    }),
    ("webshell", "WebShell - Filename", "critical", "webshell", "T1505", 0.95, {
        "url": r"shell\.php|cmd\.php|backdoor",
    }),
    ("webshell", "WebShell - preg_replace", "critical", "webshell", "T1505", 0.95, {
        "url": r"preg_replace.*\$_",
    }),
    ("webshell", "WebShell - Uploads Path", "high", "webshell", "T1505", 0.8, {
        "url": r"/uploads/.*\.php|/temp/.*\.php",
    }),
    ("xss_attack", "XSS - Script Tag", "high", "xss", "T1190", 0.9, {
        "url": r"(<script|</script>)",
    }),
    ("xss_attack", "XSS - JavaScript Event", "high", "xss", "T1190", 0.85, {
        "url": r"(onload|onerror|onmouseover|onclick|onfocus).*=",
    }),
    ("xss_attack", "XSS - Iframe Injection", "high", "xss", "T1190", 0.9, {
        "url": r"(<iframe|<object|<embed)",
    }),
    ("xss_attack", "XSS - SVG Injection", "high", "xss", "T1190", 0.8, {
        "url": r"(<svg|<math|<foreignObject)",
    }),
)
