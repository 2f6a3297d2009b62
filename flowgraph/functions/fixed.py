"""Word lists, patterns and numbers that artifacts and results depend on."""

# Fixed values of the channel model.
MQ_KINDS = ("kafka", "rabbitmq")
HTTP_KINDS = ("http", "websocket", "graphql")
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
LOCAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1", "host.docker.internal", "")
WILD_SEGMENT = r"^(\{.*\}|:.+|<.*>|\$\{.*\}|\[.*\]|\*+|__[A-Z_]+__)$"
TOPIC = r"^[A-Za-z0-9][A-Za-z0-9._-]{1,}$"
RPC = r"^/?[A-Za-z_][\w.]*\.[A-Za-z_]\w*/[A-Za-z_]\w*$"
NOT_CHANNELS = (
    "get", "post", "put", "delete", "patch", "head", "options",
    "application/json", "application/xml", "text/plain", "text/html",
    "application/x-www-form-urlencoded", "multipart/form-data", "utf-8",
)

# Fixed values of matching.
EXACT_BASE, SUFFIX_BASE = 1.0, 0.75
VERB_MISMATCH, HOST_VERB_MISMATCH = 0.35, 0.5
HOST_BOOST, HOST_ONLY, RPC_SUFFIX = 0.15, 0.6, 0.7
MIN_SCORE, MATCHES_PER_SERVICE = 0.4, 2
HANDLER_LINES, SOURCE_LINES, FALLBACK_SCORE, SOURCE_SCORE = 150, 600, 0.4, 0.9
MAX_DEPTH, MAX_PATHS, MAX_PATHS_PER_SINK = 14, 4000, 40

# Fixed values of text heuristics, in the order in which the first match counts.
VERB_HINTS = (
    ("POST", r"(?i)\b(post|postfor|create|publish|send)\w*\("),
    ("PUT", r"(?i)\b(put|update)\w*\("),
    ("DELETE", r"(?i)\b(delete|remove)\w*\("),
    ("PATCH", r"(?i)\bpatch\w*\("),
    ("GET", r"(?i)\b(get|getfor|fetch|retrieve|exchange)\w*\("),
)
PROTOCOL_HINTS = (
    ("kafka", r"(?i)kafka|streambridge|kstream|sarama|producermessage|kafka\.writer"),
    ("rabbitmq", r"(?i)rabbit|amqp|basicpublish"),
    ("grpc", r"(?i)grpc|\bstub\b|\.newcall\("),
    ("websocket", r"(?i)websocket|\.sendtext\("),
    ("graphql", r"(?i)graphql|\bgql\b"),
    ("dubbo", r"(?i)dubbo|\$invoke"),
)
URL = r"""https?://[^\s"'`)]+"""
QUOTED_PATH = r"""["'`](/[A-Za-z0-9_./:{}<>*\-]*)["'`]"""
QUOTED_TOKEN = r"""["'`]([A-Za-z0-9][A-Za-z0-9._\-]{2,})["'`]"""
NAMED_TOPIC = r"""["'`]([A-Za-z][A-Za-z0-9]*(?:[.\-_][A-Za-z0-9]+)+)["'`]"""
PUBLISH = r"(?i)\b(send|publish|produce|emit|dispatch|enqueue)\w*\("
VENDOR_PATH = (
    r"(^|/)(node_modules|site-packages|dist-packages|vendor|third_party|\.venv|venv|"
    r"target/generated-sources|build|__pycache__|testdata|test/|tests/)(/|$)"
)

# Fixed values of route scanning: pattern, group of the verb (0: none) and of the route, verbs that mean none.
ROUTES = (
    (r"""(?i)@(Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?["']([^"']+)["']""", 1, 2, "REQUEST"),
    (r"""(?i)@\w+\.(get|post|put|delete|patch|route)\(\s*["']([^"']+)["']""", 1, 2, "ROUTE"),
    (r"""(?i)@\w+\.route\(\s*["']([^"']+)["'](?:[^)]*methods\s*=\s*\[([^\]]*)\])?""", 2, 1, ""),
    (r"""\.(GET|POST|PUT|DELETE|PATCH|HandleFunc|Handle)\(\s*["']([^"']+)["']""", 1, 2, "HANDLE"),
    (r"""\b(?:app|router)\.(get|post|put|delete|patch|all)\(\s*["']([^"']+)["']""", 1, 2, "ALL"),
    (r"""(?i)\[Http(Get|Post|Put|Delete|Patch)\(\s*["']([^"']+)["']\s*\)\]""", 1, 2, ""),
)
ROUTE_PREFIX = r"""@RequestMapping\(\s*(?:value\s*=\s*|path\s*=\s*)?["']([^"']+)["']"""
PREFIX_LINES, HANDLER_WINDOW = 400, 8
HANDLER_NAME = (
    r"(?:def|func|fn)\s+([A-Za-z_]\w*)"
    r"|(?:public|private|protected|internal|static|async|\s)+[\w<>\[\],.?]+\s+([A-Za-z_]\w*)\s*\("
    r"|(?:const|let|var|function)\s+([A-Za-z_]\w*)\s*=?"
)
NOT_HANDLERS = ("if", "for", "return", "new")
SOURCE_FILES = {
    "java": (".java",), "python": (".py",), "go": (".go",), "javascript": (".js", ".mjs", ".ts"),
    "typescript": (".ts",), "csharp": (".cs",), "cpp": (".cc", ".cpp", ".cxx"),
}

# Fixed values of identifiers and function validity.
CLASS_WORDS = ("Dto", "DTO", "Form", "Request", "Response", "Entity", "Bean", "Model", "Vo", "VO")
JAVA_LAMBDA_NAMES = ("apply", "accept", "test", "get")
JAVA_INITIALISERS = ("<init>", "<clinit>")
PYTHON_NOISE = ("__module__", "__qualname__", "__dict__", "__doc__", "__weakref__")

# Fixed values of name patterns for privileged operations, on lower-case names; a category holds if any pattern is found.
QUERY_VERBS = "^(is|has|can|check|verif|valid|test|get|read|load|fetch|retrieve)"
SINK_NAMES = {
    "command": (
        "(execut|run|invok|launch|start|call).*(command|cmd|process|script|shell|bash)",
        "(command|cmd|process|script|shell|bash).*(execut|run|invok|launch|start|call)",
    ),
    "user": (
        "(creat|add|insert|new).*(user|account|member|person)",
        "(delet|remov|destroy|kill).*(user|account|member|person)",
        "(updat|modif|chang|edit).*(user|account|member|person)",
        "(user|account|member|person).*(creat|add|delet|remov|updat|modif)",
        "(lock|unlock|enabl|disabl|activ|deactiv).*(user|account)",
        "(user|account).*(lock|unlock|enabl|disabl|activ|deactiv)",
    ),
    "permission": (
        "(grant|assign|add|giv).*(permission|privil|right|access|role|author)",
        "(revok|remov|delet|deny|block).*(permission|privil|right|access|role|author)",
        "(permission|privil|right|access|role|author).*(grant|assign|revok|remov|add|giv|delet)",
        "(elevat|promot|demot|upgrad|downgrad).*(user|role|privil|access)",
    ),
    "database": (
        "(execut|run|perform|call).*(sql|query|statement)",
        "(sql|query|statement).*(execut|run|perform|call)",
    ),
    "credential": (
        "(set|chang|updat|reset|modif|alter).*(password|passwd|pwd|credential|secret|key|token)",
        "(password|passwd|pwd|credential|secret|key|token).*(set|chang|updat|reset|modif|alter)",
        "(generat|creat|produc|make|build).*(password|passwd|pwd|credential|secret|key|token)",
        "(password|passwd|pwd|credential|secret|key|token).*(generat|creat|produc|make|build)",
        "(encrypt|decrypt|hash|unhash|sign|verify).*(password|passwd|pwd|credential|secret)",
    ),
    "system": (
        "(admin|administrat|manag|control|govern|supervis).*(system|server|service|resource)",
        "(system|server|service|resource).*(admin|administrat|manag|control|govern|supervis)",
        "(shutdown|restart|reboot|reload|refresh|stop|start|kill|terminat).*(system|server|service|process)",
        "(backup|restor|recover|migrat|deploy|install|uninstall).*(system|database|service|application)",
        "(configur|setting|property).*(chang|updat|modif|set|reset)",
    ),
}
#: These patterns and the tables below are for Java names.
#: Categories that never hold for names that begin with a query verb.
QUERY_EXEMPT = ("credential", "system")
#: Names that count as commands or statements if an argument's text shows it.
COMMAND_NAMES = "(execut|run|invok|perform|call)"
COMMAND_WORDS = "(sudo|su|cmd|bash|sh|powershell|chmod|chown|rm|del|kill|ps)"
DDL_WORDS = r"(drop|create|alter|truncate|grant|revoke)\s+"

# Fixed values of calls on library types by category: type, methods (a constructor is <init>, a % ends a prefix).
TYPE_SINKS = {
    "file": (
        ("java.io.File", ("<init>", "delete", "mkdir", "mkdirs", "createNewFile", "setWritable", "setReadable", "setExecutable", "renameTo")),
        ("java.nio.file.Paths", ("get",)),
        ("java.nio.file.Files", ("delete", "deleteIfExists", "move", "copy", "createDirectory", "createDirectories", "write", "setPosixFilePermissions")),
    ),
    "process": (("java.lang.Runtime", ("exec",)), ("java.lang.ProcessBuilder", ("command", "directory", "<init>"))),
    "network": (("java.net.Socket", ("<init>",)), ("java.net.ServerSocket", ("<init>",)), ("java.net.DatagramSocket", ("<init>",)), ("java.net.URL", ("openConnection",))),
    "config": (("java.lang.System", ("setProperty", "setProperties", "setSecurityManager", "exit")), ("java.lang.Runtime", ("addShutdownHook", "halt"))),
    "sql": (("java.sql.DriverManager", ("getConnection",)), ("java.sql.Statement", ("execute%",))),
    "security": (
        ("java.security.AccessController", ("checkPermission", "doPrivileged", "doPrivilegedWithCombiner")),
        ("java.security.Policy", ("setPolicy", "getPermissions")),
        ("java.lang.SecurityManager", ("check%",)),
    ),
    "reflection": (
        ("java.lang.Class", ("forName", "newInstance")), ("java.lang.ClassLoader", ("loadClass", "defineClass")), ("java.lang.reflect.Method", ("setAccessible", "invoke")),
        ("java.lang.reflect.Field", ("setAccessible",)), ("java.lang.reflect.Constructor", ("setAccessible",)),
    ),
    "crypto": (
        ("javax.crypto.Cipher", ("getInstance", "init", "generateKey")), ("javax.crypto.KeyGenerator", ("getInstance", "init", "generateKey")),
        ("java.security.Signature", ("getInstance", "initSign", "initVerify")),
    ),
}
STANDARD_PACKAGES = r"^(java|javax|sun|com\.sun)\."
SINK_ANNOTATIONS = (
    "org.springframework.security.access.prepost.PreAuthorize", "org.springframework.security.access.prepost.PostAuthorize",
    "javax.annotation.security.RolesAllowed", "javax.annotation.security.DenyAll", "javax.annotation.security.RunAs",
)
PRIVILEGED = "privileged"

# Fixed values of names that tell of authentication and authorization.
AUTH_METHOD = "(?i)(authenticate|isAuthenticated|checkAuth|verifyAuth|login|logout|hasRole|hasPermission|isAuthorized|checkPermission|checkRole|canAccess|isAdmin|isOwner|validateUser|verifyUser|checkAccess|hasAccess|isAllowed|checkCredentials|verifyCredentials|hasAuthority)"
NO_AUTH_METHOD = "(?i)(test|mock|stub|example|demo|sample)"
AUTH_VARIABLE = "(?i)(authenticated|authorized|currentUser|principal|subject|securityContext|userRole|userPermission|isAdmin|isOwner|hasAccess|canAccess|allowAccess|grantAccess)"
AUTH_FIELD = "(?i)(authenticated|authorized|isAdmin|isOwner|hasAccess|canAccess|allowAccess|grantAccess|isActive|isEnabled|isValid|hasRole|hasPermission)"
AUTH_TYPE = "(?i)(User|Principal|Subject|Role|Permission|Authority|Security|Auth)"
SECURITY_PACKAGES = ("org.springframework.security.", "javax.security.", "jakarta.security.", "org.apache.shiro.", "com.auth0.")

# Fixed values of limits and texts.
NAME_LIMIT, AST_LIMIT, FUNCTION_LIMIT, TOP_OPERATIONS, VALIDATED_METHODS = 200, 2000, 5000, 10, 10
CONTEXT_LINES, CLIP_ITEMS, CLIP_CHARS, FIELD_LINES = 12, 40, 6000, 50
GATEWAY_BYTES, DESCRIPTION_CHARS, SPAN_LIMIT, SPAN_DEFAULT = 1_000_000, 400, 60, 30
ASSESSMENTS = ("True Positive", "False Positive", "Unknown", "Needs More Context")
AUTH_MARK = "// <--POTENTIAL AUTH CHECK"
NO_FUNCTION = "N/A"
