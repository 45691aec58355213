"""Limits, thresholds and vocabularies of the analyses, in one place."""

# Limits of submissions.
MAX_CODE_CHARS = 20_000
ACCEPTED_EXTENSIONS = (".py", ".java")
DEFAULT_FILENAME = "pasted-snippet"
LANGUAGES = ("Python", "Java")
STATUSES = ("received", "queued", "analyzing", "completed", "failed")

# Thresholds of the code checks.
LONG_METHOD_LINES = 40
HIGH_CYCLOMATIC = 10
HIGH_COGNITIVE = 15
LONG_PARAMETERS = 5
GOD_CLASS_METHODS = 15
GOD_CLASS_LINES = 300
FAT_INTERFACE_METHODS = 7
CONCRETE_CLASSES = 3
CLONE_LINES = 4
CLONE_SCANNED_LINES = 2_000
CLONE_LEAST_CHARS = 20
CLONE_FINDINGS = 5
MAGIC_ALLOWED = (0, 1, -1, 2, 100)
MAGIC_FINDINGS = 2
UNUSED_VARIABLES = 3
PYTHON_EXCEPTIONS = ("Exception", "ValueError", "TypeError", "KeyError", "IndexError", "AttributeError", "RuntimeError", "StopIteration", "NotImplementedError", "OSError", "FileNotFoundError", "ZeroDivisionError", "ImportError", "PermissionError")
JAVA_UTILITIES = ("ArrayList", "HashMap", "HashSet", "LinkedList", "StringBuilder", "StringBuffer", "TreeMap", "TreeSet", "Random", "Scanner", "Object", "Exception", "RuntimeException", "IllegalArgumentException", "IllegalStateException")
JAVA_CONTROL = ("if", "for", "while", "switch", "catch", "synchronized")
JAVA_OPERATORS = ("+", "-", "*", "/", "%", "=", "==", "!=", "<", ">", "<=", ">=", "&&", "||", "!", "++", "--", "+=", "-=", "*=", "/=", "new", "if", "for", "while", "return", "catch", "case")

# Severities, with their rank, base risk and the points they cost.
SEVERITIES = ("Low", "Medium", "High", "Critical")
SEVERITY_RANK = {"Low": 1, "Medium": 2, "High": 3, "Critical": 4}
BASE_RISK = {"Low": 3.0, "Medium": 5.5, "High": 7.5, "Critical": 9.3}
OTHER_RISK = 5.0
IMPACT_RISK, MOST_RISK = 0.6, 10.0
QUALITY_PENALTY = {"Low": 2, "Medium": 5, "High": 10, "Critical": 15}
OTHER_QUALITY_PENALTY = 3
SECURITY_PENALTY = {"Low": 3, "Medium": 8, "High": 15, "Critical": 25}
OTHER_SECURITY_PENALTY = 5
NO_FUNCTION_SCORE = 90

# Merging of findings, and their sources.
MATCHES_PER_RULE = 3
EVIDENCE_CHARS = 200
NEAR_LINES = 3
AGREEMENT_BONUS = 0.15
STATIC_RULES, SEMANTIC, STATIC_ANALYSIS, MERGED = "static_rules", "llm_semantic", "static_analysis", "merged"
DEFAULT_CONFIDENCE = 0.6
FALLBACK_CATEGORY = "Missing Input Validation"

# Chunks and metadata of knowledge documents.
CHUNK_CHARS = 1_000
CHUNK_OVERLAP = 150
KNOWLEDGE_CATEGORIES = ("owasp_top_10", "secure_coding", "vulnerability", "identity", "data_handling", "operations", "file_and_session")
DEFAULT_SOURCE = "internal-authored"
