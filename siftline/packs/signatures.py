"""Short signature list, four groups."""

# Group and its patterns (case-insensitive).
PATTERNS = (
    ("sql_injection", (r"union select", r"or 1=1", r"' --", r"xp_cmdshell", r"information_schema")),
    ("xss", (r"<script>", r"javascript:", r"onerror=", r"onload=")),
    ("path_traversal", (r"\.\./", r"etc/passwd", r"boot.ini")),
    ("command_injection", (r";\s*cat\s", r";\s*ls\s", r"\|\s*wget", r"\|\s*curl")),
)
