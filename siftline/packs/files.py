"""Content rules for scanned files."""

# Name, confidence, pattern (case-insensitive); the first hit decides.
FIRST_HIT = (
    ("eval($_REQUEST", 0.9, r"eval\s*\(\s*\$"),
    ("system($_REQUEST", 0.9, r"system\s*\(\s*\$"),
    ("shell_exec($_REQUEST", 0.85, r"shell_exec\s*\(\s*\$"),
    ("passthru($_REQUEST", 0.85, r"passthru\s*\(\s*\$_"),
    ("exec($_REQUEST", 0.85, r"exec\s*\(\s*\$_"),
    ("assert($_REQUEST", 0.9, r"assert\s*\(\s*\$_"),
    ("base64_decode($_", 0.7, r"base64_decode\s*\(\s*\$"),
    ("gzinflate+base64", 0.8, r"gzinflate\s*\(\s*base64_decode"),
    ("encoded string", 0.7, r"""\$\w+\s*=\s*["'][A-Za-z0-9+/=]{50,}["']"""),
    ("suspicious name", 0.8, r"cmd\.php|shell\.php|hack\.php"),
)

# Per language name, weight, pattern (case-insensitive); the highest weight counts.
BY_LANGUAGE = {
    "php": (
        ("eval call", 0.9, r"eval\s*\("),
        ("system call", 0.9, r"system\s*\("),
        ("shell_exec call", 0.9, r"shell_exec\s*\("),
        ("passthru call", 0.9, r"passthru\s*\("),
        ("exec call", 0.85, r"exec\s*\("),
        ("assert call", 0.9, r"assert\s*\("),
        ("preg_replace /e", 0.95, r"preg_replace\s*\([^)]*\/e"),
        ("call_user_func call", 0.85, r"call_user_func\s*\("),
        ("request parameter called", 0.8, r"\$_(?:GET|POST|REQUEST)\[.*\]\s*\("),
        ("eval of request parameter", 0.9, r"eval\s*\(\s*\$_"),
        ("base64 decoding", 0.7, r"base64_decode\s*\([^)]+\)"),
        ("gzinflate and base64", 0.85, r"gzinflate\s*\(\s*base64_decode"),
        ("gzuncompress and base64", 0.85, r"gzuncompress\s*\(\s*base64_decode"),
        ("variable variable call", 0.85, r"\$\$\w+\s*\([^)]*\$_(?:GET|POST|REQUEST)"),
        ("create_function call", 0.85, r"create_function\s*\("),
        ("phpinfo call", 0.7, r"phpinfo\s*\("),
        ("file upload", 0.75, r"\$_FILES\["),
        ("uploaded file moved", 0.8, r"move_uploaded_file\s*\("),
    ),
    "jsp": (
        ("import", 0.5, r"<%@\s*import"),
        ("class block", 0.7, r"<%!\s*.*class"),
        ("runtime exec", 0.95, r"Runtime\.getRuntime\(\)\.exec"),
        ("process builder", 0.9, r"ProcessBuilder"),
        ("request parameter", 0.6, r"\.getParameter\s*\("),
    ),
    "asp": (
        ("vbscript", 0.6, r"<%@.*language.*vbscript"),
        ("execute call", 0.9, r"Execute\s*\("),
        ("eval call", 0.85, r"Eval\s*\("),
        ("session add", 0.6, r"Session\.Add\s*\("),
        ("form request", 0.6, r"Request\.Form\["),
    ),
}

# Names of known tools with weights.
TOOLS = (
    ("behinder", 0.9), ("rebeyond", 0.9), ("godzilla", 0.9), ("antsword", 0.9), ("chopper", 0.85), ("caidao", 0.85),
)

# An encoded string (case-sensitive) and its weight; extensions; the five level bounds.
ENCODED = ("encoded string", 0.75, r"""\$\w+\s*=\s*["'][A-Za-z0-9+/=]{50,}["']""")
EXTENSIONS_FIRST_HIT = (".php", ".jsp", ".asp", ".aspx", ".html", ".js")
EXTENSIONS_BY_SCORE = (".php", ".jsp", ".asp", ".aspx", ".txt")
LANGUAGE_OF = {"php": "php", "jsp": "jsp", "asp": "asp", "aspx": "asp"}
BOUNDS = ((0.9, "CRITICAL"), (0.8, "HIGH"), (0.6, "MEDIUM"), (0.4, "LOW"))
HIGH_CONFIDENCE = 0.8
SUSPICIOUS = 0.6
