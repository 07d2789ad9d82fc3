"""The rules of the security scan. Fixed values throughout: patterns, keywords, thresholds and severities must be these for findings to be the same.

A rule has an id, a severity, the languages it applies to, keywords of which a text must hold one, in lower case, and a pattern or a named handler. ``group`` is the group whose
value is judged, ``entropy_min`` the bits a character that it needs, ``allow`` what clears it, ``deny`` what clears its lines; ``count_min`` findings make one; ``skip_in_tests`` leaves tests out.
"""

from __future__ import annotations

ALL = ["*"]
JS, WEB, PY = ["javascript", "typescript"], ["javascript", "typescript", "html"], ["python"]
ENV = ["process.env", "os.environ", "getenv", "deno.env", "import.meta.env"]
ENV_DENO = ["process.env", "os.environ", "getenv", "deno.env"]
ENV_SYSTEM = ["process.env", "os.environ", "getenv", "system.getenv"]


def _rule(id_: str, severity: str, applies_to: list[str], keywords: list[str], pattern: str | None = None, **more) -> dict:
    return {"id": id_, "severity": severity, "applies_to": applies_to, "keywords": keywords, "pattern": pattern, **more}


COMMON = [
    _rule("S001", "high", ALL, ["password", "passwd", "pwd", "secret", "api_key", "apikey", "token", "auth"], r"(?i)(?:password|passwd|pwd|secret|api_key|apikey|token|auth)\s*[=:]\s*['\"]([^'\"]{4,})['\"]", group=1, entropy_min=2.5,
          deny=["process.env", "os.environ", "getenv", "config.", "deno.env", "import.meta.env"], allow=["example", "your-", "your_", "placeholder", "changeme", "xxxxxxxx", "${", "<token>", "<password>", "redacted"]),
    _rule("S002", "medium", JS, ["eval("], r"\beval\s*\("),
    _rule("S003", "medium", JS, ["function("], r"(?:\bnew\s+Function\s*\(|(?<![A-Za-z0-9_])Function\s*\()"),
    _rule("S004", "medium", JS, ["child_process", "execsync", "execfile"], r"(?:\bchild_process\b|\bexecSync\s*\(|\bexecFile(?:Sync)?\s*\(|\bspawnSync?\s*\()"),
    _rule("S005", "low", JS, ["console."], r"\bconsole\.(?:log|debug|info)\(", count_min=4, skip_in_tests=True),
    _rule("S006", "low", ALL, ["todo", "fixme", "hack", "xxx"], r"\b(?:TODO|FIXME|HACK|XXX)\b", count_min=5, skip_in_tests=True),
    _rule("S010", "medium", ["python", "javascript", "typescript", "go", "java", "csharp"], ["md5", "sha1", "createhash"],
          r"(?:hashlib\.(?:md5|sha1)\s*\(|hashlib\.new\(\s*['\"](?:md5|sha1)['\"]|crypto\.createHash\(\s*['\"](?:md5|sha1)['\"]\)|md5\.New\(|sha1\.New\(|MessageDigest\.getInstance\(\s*\"(?:MD5|SHA-?1)\")"),
    _rule("S011", "high", ALL, ["akia", "asia", "abia", "acca"], r"\b((?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16})\b", group=1, entropy_min=3.0, allow=["example", "xxxxxx", "0000000000000000"]),
    _rule("S012", "high", ALL, ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], r"\b(gh[pousr]_[A-Za-z0-9]{36,255})\b", group=1, entropy_min=3.0),
    _rule("S013", "high", ALL, ["private key"], r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----"),
    _rule("S014", "high", ["python", "javascript", "typescript", "go"], ["verify=false", "rejectunauthorized", "insecureskipverify"], r"(?:\bverify\s*=\s*False\b|rejectUnauthorized\s*:\s*false|InsecureSkipVerify\s*:\s*true)"),
    _rule("S051", "high", ALL, ["aws_secret", "awssecret", "secretaccesskey"], r"(?i)aws[_\-]?secret[_\-]?(?:access[_\-]?)?key\s*[=:]\s*['\"]?([A-Za-z0-9/+=]{40})(?=['\"]|\s|$|,)", group=1, entropy_min=4.0,
          deny=["process.env", "os.environ", "getenv", "system.getenv", "deno.env", "import.meta.env"], allow=["example", "your-", "your_", "placeholder", "xxxxxx", "redacted", "wjalrxutnfemi/k7mdeng"]),
    _rule("S052", "high", ALL, ["service_account"], r"\"type\"\s*:\s*\"service_account\"[^\n]{0,500}\"private_key\""),
    _rule("S053", "high", ALL, ["aiza"], r"\b(AIza[0-9A-Za-z_\-]{35})\b", group=1, entropy_min=3.0, allow=["example", "your-", "placeholder", "xxxxxx"]),
    _rule("S054", "high", ALL, ["accountkey="], r"AccountKey\s*=\s*([A-Za-z0-9+/=]{60,100})(?=;|\"|'|\s|$)", group=1, entropy_min=4.0, deny=ENV_SYSTEM, allow=["example", "your", "placeholder", "xxxxxx", "redacted"]),
    _rule("S055", "high", ALL, ["xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"], r"\b(xox[baprs]-[A-Za-z0-9\-]{10,})\b", group=1, entropy_min=3.0, allow=["example", "your-", "xxxxxx", "redacted"]),
    _rule("S056", "high", ALL, ["hooks.slack.com"], r"https://hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]{20,}", allow=["example", "your", "redacted", "xxxxxx"]),
    _rule("S057", "high", ALL, ["sk_live_", "rk_live_"], r"\b((?:sk|rk)_live_[0-9a-zA-Z]{20,})\b", group=1, entropy_min=3.5, allow=["example", "your-", "xxxxxx", "redacted"]),
    _rule("S058", "high", ALL, ["sg."], r"\b(SG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43})\b", group=1, entropy_min=3.5, allow=["example", "your", "placeholder", "redacted"]),
    _rule("S059", "high", ALL, ["twilio"], r"\b(SK[0-9a-fA-F]{32})\b", group=1, entropy_min=3.0, allow=["example", "your", "redacted", "xxxxxx"]),
    _rule("S060", "high", ALL, ["npm_"], r"\b(npm_[A-Za-z0-9]{36})\b", group=1, entropy_min=3.5, allow=["example", "your-", "placeholder", "redacted"]),
    _rule("S061", "high", ALL, ["pypi-"], r"\b(pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_\-]{50,})\b", group=1, entropy_min=3.5),
    _rule("S062", "high", ALL, ["glpat-"], r"\b(glpat-[A-Za-z0-9_\-]{20})\b", group=1, entropy_min=3.0, allow=["example", "your", "redacted", "xxxxxx"]),
    _rule("S063", "high", ALL, ["discord"], r"\b([MN][A-Za-z\d]{23}\.[\w\-]{6}\.[\w\-]{27})\b", group=1, entropy_min=3.5, allow=["example", "your", "redacted"]),
    _rule("S064", "high", ALL, ["sk-proj-", "openai"], r"\b(sk-(?:proj-|svcacct-)?[A-Za-z0-9_\-]{40,})\b", group=1, entropy_min=4.0, deny=ENV, allow=["example", "your-", "placeholder", "redacted", "xxxxxx", "sk-ant-", "sk_live_", "sk_test_"]),
    _rule("S065", "high", ALL, ["sk-ant-"], r"\b(sk-ant-(?:api|sid)\d{2}-[A-Za-z0-9_\-]{80,})\b", group=1, entropy_min=4.0, deny=ENV_DENO, allow=["example", "your-", "placeholder", "redacted", "xxxxxx"]),
    _rule("S066", "high", ALL, ["hf_"], r"\b(hf_[A-Za-z0-9]{34})\b", group=1, entropy_min=3.0, allow=["example", "your", "placeholder", "redacted"]),
    _rule("S067", "high", ALL, ["age-secret-key", "putty-user-key"], r"(?:AGE-SECRET-KEY-1[A-Z0-9]{20,}|PuTTY-User-Key-File-[2-9])"),
    _rule("S068", "high", ALL, ["postgres://", "mysql://", "mongodb://", "mongodb+srv://", "redis://", "mariadb://", "amqp://"],
          r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|mariadb|amqp)://[A-Za-z0-9._~\-%]+:([^@\s/'\"<>]{4,})@[A-Za-z0-9._\-]+", group=1, entropy_min=2.0, deny=[*ENV_SYSTEM, "deno.env"],
          allow=["password", "your_", "your-", "placeholder", "changeme", "redacted", "%s", "%25s", "${", "<password>", "xxxxxx"]),
    _rule("S069", "high", ALL, ["jdbc:"], r"(?i)jdbc:[a-z0-9:]+://[^\s'\"<>]+[?;&]password=([^&\s'\"<>]{4,})", group=1, entropy_min=2.0, deny=["system.getenv", "process.env", "getenv"],
          allow=["password", "your_", "placeholder", "changeme", "redacted", "${", "<password>"]),
    _rule("S070", "high", ALL, ["http://", "https://"], r"\bhttps?://[A-Za-z0-9._~\-]+:([^@\s/'\"<>]{4,})@[A-Za-z0-9._\-]+", group=1, entropy_min=2.0, deny=ENV_DENO,
          allow=["password", "your_", "your-", "placeholder", "changeme", "redacted", "${", "<password>", "%s", "example.com"]),
]
GO = [
    _rule("S050", "high", ["go"], ["exec.command"], r"exec\.Command\s*\(\s*\"(?:sh|bash|cmd|powershell)\"\s*,\s*\"(?:-c|/c|-Command)\""),
    _rule("S093", "medium", ["go"], ["\"math/rand\""], r"(?m)^\s*(?:_\s+)?\"math/rand\"\s*$"),
    _rule("S094", "medium", ["go"], ["\"crypto/md5\"", "\"crypto/sha1\""], r"(?m)^\s*(?:_\s+)?\"crypto/(?:md5|sha1)\"\s*$"),
    _rule("S095", "medium", ["go"], ["listenandserve"], r"\bhttp\.ListenAndServe\s*\("),
    _rule("S096", "low", ["go"], ["\"unsafe\""], r"(?m)^\s*(?:_\s+)?\"unsafe\"\s*$"),
]
HTML = [
    _rule("S119", "medium", ["html"], ["target=\"_blank\"", "target='_blank'"], r"<a\b[^>]*\btarget\s*=\s*['\"]_blank['\"](?![^>]*\brel\s*=\s*['\"][^'\"]*\bnoopener\b)", count_min=1),
    _rule("S120", "medium", ["html"], ["<script"], r"<script\b[^>]*\bsrc\s*=\s*['\"]https?://(?![^>]*\bintegrity\s*=)"),
    _rule("S121", "medium", ["html"], ["<form"], r"<form\b[^>]*\baction\s*=\s*['\"]http://"),
]
INFRA = [
    _rule("S110", "medium", ["dockerfile"], ["from "], handler="container_user"),
    _rule("S111", "medium", ["dockerfile"], ["add "], r"(?im)^\s*ADD\s+https?://"),
    _rule("S112", "low", ["dockerfile"], ["from "], r"(?im)^\s*FROM\s+(?!scratch\b)\S+:latest\b", count_min=1),
    _rule("S113", "high", ["dockerfile"], ["--privileged", "--security-opt"], r"(?:--privileged\b|--security-opt(?:=|\s+)['\"]?(?:apparmor=unconfined|seccomp=unconfined))"),
    _rule("S114", "low", ["dockerfile"], ["apt-get install", "apt install"], handler="apt_cleanup"),
    _rule("S115", "high", ["yaml"], ["privileged:", "runasnonroot:", "allowprivilegeescalation:"], r"(?im)^\s*(?:privileged|allowPrivilegeEscalation)\s*:\s*true\s*$|^\s*runAsNonRoot\s*:\s*false\s*$"),
    _rule("S116", "medium", ["yaml"], ["hostnetwork:", "hostpid:", "hostipc:"], r"(?im)^\s*(?:hostNetwork|hostPID|hostIPC)\s*:\s*true\s*$"),
    _rule("S117", "high", ["yaml", "*"], ["\"action\"", "\"resource\"", "verbs:"], handler="wildcard_iam"),
    _rule("S118", "high", ["terraform"], ["0.0.0.0/0", "ingress"], r"(?m)cidr_blocks\s*=\s*\[\s*\"0\.0\.0\.0/0\"\s*\]"),
]
JVM = [
    _rule("S097", "high", ["java"], ["runtime.getruntime"], r"\bRuntime\.getRuntime\s*\(\s*\)\s*\.exec\s*\("),
    _rule("S098", "high", ["java"], ["objectinputstream", "readobject", "xmldecoder"], r"\b(?:new\s+ObjectInputStream\s*\(|\.readObject\s*\(\s*\)|new\s+XMLDecoder\s*\()"),
    _rule("S099", "high", ["java", "csharp"], ["cipher.getinstance", "createencryptor"],
          r"(?:Cipher\.getInstance\s*\(\s*\"(?:AES/ECB|DES|DESede|RC2|RC4|Blowfish)[^\"]*\"|new\s+(?:DES|RC2|RC4|TripleDES)CryptoServiceProvider\s*\(|\.Mode\s*=\s*CipherMode\.ECB)"),
    _rule("S100", "medium", ["java"], ["class.forname"], r"\bClass\.forName\s*\(\s*(?![\"'])"),
    _rule("S101", "high", ["csharp"], ["binaryformatter", "soapformatter", "netdatacontractserializer", "losformatter"], r"\bnew\s+(?:BinaryFormatter|SoapFormatter|NetDataContractSerializer|LosFormatter|ObjectStateFormatter)\s*\("),
    _rule("S102", "high", ["csharp"], ["sqlcommand"], r"new\s+SqlCommand\s*\(\s*[\"$][^\")]*(?:\+\s*\w+|\{)"),
    _rule("S103", "high", ALL, ["${jndi:"], r"\$\{jndi:(?:ldap|ldaps|rmi|dns|nis|iiop|corba|nds|http)s?:"),
]
PYTHON = [
    _rule("S030", "high", PY, ["eval"], r"\beval\s*\("),
    _rule("S031", "high", PY, ["exec"], r"\bexec\s*\("),
    _rule("S032", "high", PY, ["pickle"], r"(?:\bpickle\.load|\bunpickle\b|\bcPickle\.load)"),
    _rule("S033", "high", PY, ["subprocess", "shell=true"], r"subprocess\.\w+\([^)]*shell\s*=\s*True"),
    _rule("S034", "high", PY, ["os.system", "os.popen"], r"\bos\.(?:system|popen)\s*\("),
    _rule("S035", "medium", PY, ["__import__"], r"__import__\s*\("),
    _rule("S036", "medium", PY, ["except"], r"\bexcept\s*:", count_min=3, skip_in_tests=True),
    _rule("S037", "medium", PY, ["debug"], r"\bDEBUG\s*=\s*True\b"),
    _rule("S038", "low", PY, ["assert "], r"^\s*assert\s+", count_min=6, skip_in_tests=True),
    _rule("S039", "medium", PY, ["requests."], handler="request_without_timeout"),
    _rule("S071", "medium", PY, ["random."], r"(?i)\b(?:token|secret|password|passwd|salt|nonce|csrf|reset_key|api_key|session_id)\b[^\n]{0,40}=\s*random\.(?:random|randint|randrange|choice|choices|getrandbits|sample|uniform)\s*\("),
    _rule("S072", "high", PY, ["yaml.load"], r"\byaml\.load\s*\((?![^)]*Loader\s*=\s*(?:yaml\.)?(?:Safe|CSafe)Loader)"),
    _rule("S073", "high", PY, ["xml.etree", "xml.sax", "xml.dom", "lxml.etree"], handler="unsafe_xml"),
    _rule("S074", "medium", PY, ["app.run", "debug=true"], r"\.run\s*\([^)]*\bdebug\s*=\s*True"),
    _rule("S075", "medium", PY, ["debug"], r"(?m)^\s*DEBUG\s*=\s*True\s*$"),
    _rule("S076", "medium", PY, ["mktemp"], r"\btempfile\.mktemp\s*\("),
    _rule("S077", "high", PY, ["autoaddpolicy"], r"\b(?:AutoAddPolicy|WarningPolicy)\s*\(\s*\)"),
    _rule("S078", "high", PY, ["mode_ecb"], r"\b(?:AES|DES|DES3|Blowfish|ARC2|CAST)\.MODE_ECB\b"),
    _rule("S079", "medium", PY, ["marshal.load", "shelve.open", "dill.load", "jsonpickle"], r"\b(?:marshal\.loads?|shelve\.open|dill\.loads?|jsonpickle\.decode)\s*\("),
    _rule("S080", "high", PY, ["cert_none", "_create_unverified_context"], r"(?:ssl\.CERT_NONE\b|ssl\._create_unverified_context\s*\(|verify_mode\s*=\s*ssl\.CERT_NONE\b)"),
]
SCRIPTING = [
    _rule("S104", "high", ["php"], ["eval("], r"(?<![A-Za-z0-9_])eval\s*\("),
    _rule("S105", "high", ["php"], ["shell_exec", "passthru", "system(", "proc_open", "popen(", "exec("], r"(?<![A-Za-z0-9_])(?:shell_exec|passthru|system|proc_open|popen|exec)\s*\("),
    _rule("S106", "high", ["php"], ["unserialize"], r"\bunserialize\s*\([^)]*\$_(?:GET|POST|COOKIE|REQUEST|SERVER|FILES|SESSION)"),
    _rule("S107", "high", ["php"], ["include", "require"], r"\b(?:include|require)(?:_once)?\s*\(?\s*\$_(?:GET|POST|COOKIE|REQUEST)"),
    _rule("S108", "high", ["ruby"], ["marshal.load"], r"\bMarshal\.load\s*\("),
    _rule("S109", "high", ["ruby"], ["verify_none"], r"OpenSSL::SSL::VERIFY_NONE"),
]
VBA = [
    _rule("S040", "high", ["vba"], ["sendkeys"], r"(?i)\bSendKeys\s*\("),
    _rule("S041", "high", ["vba"], ["shell"], r"(?i)\bShell\s*\("),
    _rule("S042", "high", ["vba"], ["wscript.shell"], r"(?i)CreateObject\s*\(\s*[\"']WScript\.Shell[\"']"),
    _rule("S043", "medium", ["vba"], ["application.run"], r"(?i)Application\.Run\s*\("),
    _rule("S044", "medium", ["vba"], ["on error resume next"], r"(?i)On\s+Error\s+Resume\s+Next", count_min=3),
]
PAGES = [
    _rule("S020", "high", ["python", "javascript", "typescript", "java", "csharp", "php"], ["query(", "execute(", "rawquery", "raw_sql"],
          r"(?:query|execute|rawQuery|raw_sql)\s*\(\s*['\"`][^'\"`]*(?:\s*\+|\$\{)[^'\"`]*(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE)"),
    _rule("S022", "high", JS, ["dangerouslysetinnerhtml"], r"\bdangerouslySetInnerHTML\b"),
    _rule("S023", "high", ALL, ["eyj"], r"\b(eyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,})\b", group=1, entropy_min=3.5),
    _rule("S081", "medium", WEB, ["document.write"], r"\bdocument\.write(?:ln)?\s*\("),
    _rule("S082", "medium", JS, ["innerhtml", "outerhtml", "insertadjacenthtml"], r"\.(?:innerHTML|outerHTML)\s*(?:\+=|=)\s*(?![`'\"]<[^`'\"<>]{0,200}>[`'\"]\s*[;)])|\.insertAdjacentHTML\s*\("),
    _rule("S083", "medium", JS, ["localstorage", "sessionstorage"], r"(?:localStorage|sessionStorage)\.setItem\s*\(\s*['\"`](?:[A-Za-z0-9_\-]*?(?:token|jwt|auth|secret|api[_-]?key|refresh|session)[A-Za-z0-9_\-]*?)['\"`]"),
    _rule("S084", "medium", JS, ["math.random"], r"(?i)\b(?:token|secret|password|passwd|salt|nonce|csrf|reset|sessionid|otp)\b[^\n]{0,80}=\s*[^;\n]{0,80}Math\.random\s*\("),
    _rule("S085", "high", JS, ["createcipher", "createdecipher"], r"\bcrypto\.create(?:Cipher|Decipher)\s*\("),
    _rule("S086", "medium", WEB, ["settimeout", "setinterval"], handler="string_timer"),
    _rule("S087", "medium", JS, ["postmessage"], r"\.postMessage\s*\([^,)]+,\s*['\"`]\*['\"`]"),
    _rule("S088", "high", JS, ["node_tls_reject_unauthorized"], r"NODE_TLS_REJECT_UNAUTHORIZED['\"]?\s*[\]:=]\s*['\"]0['\"]"),
    _rule("S089", "high", WEB, ["v-html", "bypasssecuritytrust", "ng-bind-html"], r"(?:\sv-html\s*=|\bbypassSecurityTrust(?:Html|Script|Style|Url|ResourceUrl)\s*\(|\sng-bind-html\s*=)"),
    _rule("S090", "medium", JS, ["cors", "access-control-allow-origin"], r"(?:cors\s*\(\s*\{[^}]*origin\s*:\s*['\"`]\*['\"`]|['\"]Access-Control-Allow-Origin['\"]\s*[,:]\s*['\"`]\*['\"`])"),
    _rule("S091", "medium", JS, [".html("], r"\$\([^)]+\)\.html\s*\(\s*[A-Za-z_$][\w$.]*\s*\)"),
    _rule("S092", "medium", WEB, ["javascript:"], r"(?:href|src|action|formaction)\s*=\s*['\"`]\s*javascript:"),
]
RULES = [*COMMON, *GO, *HTML, *INFRA, *JVM, *PYTHON, *SCRIPTING, *VBA, *PAGES]

LANGUAGES = {
    ".py": "python", ".pyw": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go",
    ".java": "java", ".cs": "csharp", ".php": "php", ".rb": "ruby", ".html": "html", ".htm": "html", ".vb": "vba", ".vba": "vba", ".bas": "vba", ".cls": "vba", ".frm": "vba", ".yml": "yaml", ".yaml": "yaml",
    ".tf": "terraform", ".tfvars": "terraform", ".dockerfile": "dockerfile"}
CONTAINER_FILES = ("dockerfile", "containerfile")
UNSCANNED_ENDS = (".min.js", ".min.css", ".map", ".lock", ".tfstate", ".tfstate.backup")
UNSCANNED_FOLDERS = ("node_modules", "vendor", "__pycache__", "security_rules")
TEST_FOLDERS = ("test", "tests", "spec", "specs", "__tests__", "fixtures", "mocks")
LONGEST_TEXT, MINIFIED_MEAN, HEAD_LINES, FEWEST_LINES = 200_000, 500, 50, 5
PENALTY = {"high": 2.0, "medium": 0.5, "low": 0.1}
