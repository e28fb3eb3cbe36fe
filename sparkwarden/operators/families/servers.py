"""Rules over tool-server code, guarded model calls and probe settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import regex
from ...model import issue
from ..rules import Family, Group, group

_TAINT = r"(\$\{|\+\s*\w|%\s*\w|f['\"]|\.format\()"
_FILES = r"(\.ssh|id_rsa|\.aws/credentials|\.netrc|\.npmrc|/etc/passwd|/etc/shadow|\.env\b|credentials)"

POISONING = [
    ("C", r"<hidden>"),
    ("C", r"<system>"),
    ("C", r"<instructions?>"),
    ("C", r"<secret>"),
    ("C", r"<internal>"),
    ("H", r"<!--.*?-->"),
    ("C", r"ignore\s+(all\s+)?(previous|prior|above)"),
    ("C", r"disregard\s+(all\s+)?(previous|prior|above)"),
    ("C", r"forget\s+(all\s+)?(your\s+|the\s+|previous\s+)?instructions"),
    ("C", r"new\s+instructions?\s*:"),
    ("C", r"you\s+are\s+now\s"),
    ("C", r"before\s+(executing|running|using|calling).{0,40}read"),
    ("C", r"secretly\s+(send|forward|post|upload)"),
    ("C", r"include\s+.{0,40}(contents?|file).{0,40}(response|output|reply)"),
    ("C", r"(pass|send|include)\s+.{0,40}as\s+(a\s+)?(side\s?note|debug\s+note|metadata)"),
    ("H", r"append\s+.{0,40}to\s+(the\s+|your\s+)?(output|response)"),
    ("C", r"read\s+.{0,20}(/etc/passwd|/etc/shadow|id_rsa|\.env\b|credentials)"),
    ("C", r"(access|list|open)\s+.{0,20}(~/\.ssh|~/\.aws|~/\.gnupg|~/\.config)"),
    ("H", "[\\u200b\\u200c\\u200d\\u2060\\ufeff]"),
    ("H", "[\\u202a-\\u202e\\u2066-\\u2069]"),
]
#: What a tool's description is: the quoted text after the key.
DESCRIPTION = r"description['\"]?\s*[:=]\s*(`[^`]*+`|\"[^\"]*+\"|'[^']*+')"
#: The start of a tool definition; its region is the following 500 characters.
TOOL = r"(server\.tool\s*\(|@(mcp|server)\.tool\b|registerTool\s*\(|addTool\s*\(|add_tool\s*\()"
#: Words of destructive operations.
DESTRUCTIVE = ("delete", "remove", "drop", "destroy", "truncate", "clear", "reset", "overwrite", "write", "update", "modify", "execute", "kill", "purge")
REGION = 500


def _regions(content: Column, pattern: str, length: int) -> Column:
    """array<struct<text, start>>: the text from each match of a pattern."""
    found = regex.matches(content, regex.java(pattern))
    return F.transform(found, lambda m: F.struct(F.substring(content, m["start"] + 1, F.lit(length)).alias("text"), m["start"].alias("start")))


def _tool_extra(content: Column) -> list[Column]:
    family = "mcp_server"
    described = regex.matches(content, regex.java(DESCRIPTION, dotall=True))
    g = group("MCP101", "doc_all", POISONING, 94)

    def poisoned(d: Column) -> Column:
        hits = [F.when(d["text"].rlike(regex.java(p.regex, dotall=True)), issue(family, "MCP101", p.severity, F.lit("The quoted description of a tool gives orders to the model"), regex.line_at(content, d["start"]), code=F.substring(d["text"], 1, 100), cwe=94)) for p in g.patterns]
        return F.filter(F.array(*hits), lambda i: i.isNotNull())

    tools = _regions(content, TOOL, REGION)
    spoof = group("MCP112", "line_first", [
        ("C", r"e?mail.{0,300}(password|secret|credential|\.ssh)"),
        ("H", r"format(ter)?.{0,300}(fetch\(|requests\.|axios|http)"),
        ("C", r"validat(e|or).{0,300}(exec|spawn|subprocess|os\.system)"),
        ("H", r"logg?er.{0,300}(fetch\(|requests\.|axios|http)"),
        ("C", r"util(ity)?.{0,300}(credential|password|secret|token)"),
    ], message="A tool does something its name does not suggest")

    def spoofed(t: Column) -> Column:
        out = F.lit(None)
        for p in reversed(spoof.patterns):
            hit = issue(family, "MCP112", p.severity, spoof.message, regex.line_at(content, t["start"]), cwe=345)
            out = F.when(t["text"].rlike(regex.java(p.regex, dotall=True)), hit).otherwise(out)
        return out

    words = "|".join(DESTRUCTIVE)

    def hints(t: Column) -> Column:
        # The tool's own text ends where the next tool starts.
        own = F.element_at(F.split(F.substring(t["text"], 2, REGION), regex.java(TOOL)), 1)
        named = F.regexp_extract(own, r"(?i)name['\"]?\s*[:=]\s*['\"`]([^'\"`]+)", 1)
        destructive = named.rlike(f"(?i)({words})")
        line = regex.line_at(content, t["start"])
        missing = F.when(destructive & ~own.rlike("(?i)annotations\\s*:\\s*\\{[^}]*destructiveHint\\s*:\\s*true"), issue(family, "MCP108", "MEDIUM", F.concat(F.lit("no destructiveHint on tool "), named), line))
        reading = named.rlike("(?i)(^|_)(list|get|read|fetch|search|find|show|view)") & ~destructive
        return missing.when(reading & ~own.rlike("(?i)annotations\\s*:\\s*\\{[^}]*readOnlyHint\\s*:\\s*true"), issue(family, "MCP109", "LOW", F.concat(F.lit("no readOnlyHint on tool "), named), line))

    return [F.flatten(F.transform(described, poisoned)), F.filter(F.transform(tools, spoofed), lambda i: i.isNotNull()), F.filter(F.transform(tools, hints), lambda i: i.isNotNull())]


MCP_SERVER = Family("mcp_server", (
    group("MCP101", "line_first", POISONING, 94, message="A tool's description talks to the model behind the user's back"),
    group("MCP102", "line_first", [
        ("C", r"shell\s*=\s*True"),
        ("C", rf"os\.system\s*\([^)]*{_TAINT}"),
        ("C", rf"os\.popen\s*\([^)]*{_TAINT}"),
        ("C", r"(^|[^\w.])exec\s*\(\s*\w*(input|cmd|command|user|param|arg)"),
        ("C", r"\beval\s*\(\s*\w+"),
        ("C", r"\b(exec|execSync|spawn|spawnSync)\s*\(\s*`[^`]*\$\{"),
        ("C", r"\b(exec|execSync|spawn|spawnSync)\s*\([^)]*['\"]\s*\+"),
        ("C", r"new\s+Function\s*\("),
        ("C", r"\beval\s*\(\s*`"),
    ], 78, message="A tool puts its arguments into a shell command"),
    group("MCP103", "line_first", [
        ("C", r"(execute|query)\s*\(\s*f['\"]\s*(select|insert|update|delete)"),
        ("C", r"(execute|query)\s*\(\s*['\"]\s*(select|insert|update|delete)[^'\"]*%s?['\"]\s*%"),
        ("C", r"(select|insert|update|delete)\s[^'\"]*['\"]\s*\.format\s*\("),
        ("C", r"['\"]\s*(select|insert|update|delete)\s[^'\"]*['\"]\s*\+"),
        ("C", r"\.raw\s*\(\s*['\"][^'\"]*['\"]\s*\+"),
        ("C", r"(query|execute)\s*\(\s*`\s*(select|insert|update|delete)[^`]*\$\{"),
        ("H", r"(rawQuery|queryRaw\w*)\s*\([^)]*\+"),
    ], 89, message="A tool puts its arguments into a query string"),
    group("MCP107", "line_first", [
        r"AKIA[0-9A-Z]{16}",
        r"\bsk-[a-zA-Z0-9]{32,}",
        r"\bsk-ant-[a-zA-Z0-9\-_]{20,}",
        r"\bghp_[a-zA-Z0-9]{36}",
        r"password\s*[:=]\s*['\"][^'\"]{8,}['\"]",
        r"api_?key\s*[:=]\s*['\"][^'\"]{16,}['\"]",
        r"secret\s*[:=]\s*['\"][^'\"]{8,}['\"]",
    ], 798, "C", skip_comments=True, message="A credential is written into the server's source"),
    group("MCP110", "line_first", [
        r"description\s*[:=]\s*(await\s+)?(fetch|axios|requests)",
        r"description\s*[:=]\s*(await\s+)?(get|load|fetch)\w*\s*\(",
        r"instructions?\s*[:=]\s*(await\s+)?(fetch|axios|requests)",
        r"description\s*[:=]\s*await\s",
        r"(load|fetch|get)(Remote)?(Description|Instructions?)\s*\(",
    ], 829, "H", message="What a tool says about itself can change after it was approved"),
    group("MCP111", "line_first", [
        ("C", r"(read|open)\w*\s*\([^)]*(\.ssh/|id_rsa|id_ed25519)"),
        ("C", r"(read|open)\w*\s*\([^)]*credentials"),
        ("C", r"(read|open)\w*\s*\([^)]*\.netrc"),
        ("H", r"(read|open)\w*\s*\([^)]*\.npmrc"),
        ("C", rf"(read|open)\w*\s*\([^)]*{_FILES}"),
        ("H", r"(process\.env\[\s*\w+|os\.environ\[\s*[a-z_]\w*)"),
        ("H", r"os\.(getenv|environ\.get)\s*\(\s*[a-z_]\w*"),
        ("C", r"(fetch|axios\.\w+|requests\.post)\s*\([^)]*(\+|,)\s*\w*(data|content|file|key|secret|creds?)\w*"),
        ("C", r"(fetch|axios\.\w+|requests\.post)\s*\([^)]*(process\.env|os\.environ)"),
        ("H", r"(return|res\.send)\s*[({][^)}]*readFile"),
        ("M", r"glob\w*\s*\([^)]*\*\*"),
        ("H", r"(walk|readdir\w*|listdir)\s*\([^)]*(homedir|expanduser|~|HOME)"),
    ], 200, message="A tool opens files where credentials usually live"),
    group("MCP113", "line_first", [
        ("H", r"(token|authorization)\s*[:=]\s*(req|request)\.(headers|body|query)"),
        ("H", r"authorization['\"]?\s*[:=]\s*(req|request|ctx|context)\."),
        ("C", r"process\.env\.\w+\s*\+\s*\w*(input|user|param)"),
        ("H", r"authorization['\"]?\s*[:=]\s*`[^`]*\$\{"),
        ("H", r"(impersonate|act_?as|on_?behalf_?of)\w*\s*[:=(]"),
        ("C", r"(elevate|escalate|sudo|as_?admin)\w*\s*[:=]\s*true"),
    ], 441, message="A caller's identity is passed on to another service unchecked"),
    group("MCP114", "line_first", [
        ("M", r"name['\"]?\s*[:=]\s*['\"](read_file|write_file|search|bash|shell|fetch|execute|list_files)['\"]"),
        ("M", r"(list|get|enumerate)(All)?Servers\s*\("),
        ("H", r"connect(To)?(Server)?\s*\(\s*(req|request|input|user|params)"),
        ("H", r"(override|replace|intercept)(Server|Tool)\s*\("),
        ("M", r"servers?\[\s*\w+\s*\]\s*="),
    ], 290, message="A tool or server can take the place of another one"),
    group("MCP115", "line_first", [
        ("H", r"SSE\w*Transport\s*\([^)]*['\"]http://"),
        ("H", r"EventSource\s*\(\s*['\"]http://"),
        ("M", r"(listen|bind)\s*\([^)]*0\.0\.0\.0"),
        ("M", r"host\s*[:=]\s*['\"]0\.0\.0\.0"),
        ("C", r"(rejectUnauthorized\s*:\s*false|verify\s*=\s*False)"),
        ("C", r"NODE_TLS_REJECT_UNAUTHORIZED\s*['\"]?\]?\s*=\s*['\"]?0"),
    ], 319, message="The transport is unprotected or open to other hosts"),
    group("MCP116", "line_first", [
        ("H", r"(modify|update|set|change)(Tool)?Schema\s*\("),
        ("H", r"\.(inputSchema|schema)\s*=[^=]"),
        ("H", r"\.description\s*=[^=]"),
        ("C", r"\.description\s*=\s*await\s+(fetch|axios)"),
        ("M", r"setTimeout\s*\([^)]*(registerTool|addTool|\.tool\()"),
        ("H", r"setInterval\s*\([^)]*(schema|tool|description)"),
        ("M", r"if\s*\(\s*(Date\.now|new\s+Date|time\.time)"),
    ], 915, message="A tool's definition is changed while the server runs"),
    group("MCP117", "line_first", [
        ("C", r"authorization_?endpoint\s*[:=]?\s*['\"]?[^;]*\+"),
        ("C", r"authorization_?endpoint\s*[:=]\s*`[^`]*\$\{"),
        ("C", r"authorization_?endpoint\s*[:=]\s*(req|request|input|params)"),
        ("H", r"\bopen\s*\(\s*\w*(auth\w*url|authorization)"),
        ("H", r"(webbrowser\.open|openBrowser|shell\.openExternal)\s*\(\s*\w+"),
        ("C", r"\bopen\s*\(\s*`[^`]*\$\{"),
        ("M", r"powershell[^;]*\$\("),
        ("H", r"Start-Process[^;]*\$"),
        ("M", r"mcp-remote['\"]?\s*[:@]\s*['\"]?\^?0\.(0|1\.([0-9]|1[0-5])\b)"),
        ("M", r"npx\s+(-y\s+)?mcp-remote(\s|['\"]|$)"),
        ("H", r"\.well-known/oauth-authorization-server[^;]*(\+|\$\{)"),
        ("H", r"\.well-known/openid-configuration[^;]*(\+|\$\{)"),
        ("H", r"redirect_?uri\s*[:=][^;]*\+"),
        ("H", r"token_?endpoint\s*[:=][^;]*\+"),
    ], 78, message="The sign-in flow takes addresses or commands it has not checked"),
    group("MCP118", "line_first", [
        ("C", r"(admin|root|service|elevated)_?token\s*[:=(]"),
        ("H", r"(run|execute)_?as_?service"),
        ("C", r"(bypass|skip|ignore)_?(permission|auth)\w*\s*[:=(]"),
        ("H", r"inherit_?(privileges?|permissions?)\s*[:=(]"),
        ("H", r"(context|ctx)\.(user|role|permissions)\s*=[^=]"),
        ("C", r"(override|force)_?permissions?\s*[:=(]"),
        ("H", r"tool_?(auth|token|credentials?)\s*[:=]"),
        ("C", r"(grant|add)_?(admin|role|permission)\s*\("),
        ("M", r"headers?\s*[:=]\s*(req|request)\.headers"),
        ("H", r"(proxy|forward)_?(credentials?|auth|token)\w*\s*[:=(]"),
    ], 441, message="A tool acts with more rights than its caller has"),
), gate=(r"@modelcontextprotocol", r"from\s+mcp\b", r"import\s+mcp\b", r"McpServer", r"fastmcp", r"mcp\.server", r"server\.tool\s*\(", r"@(mcp|server)\.tool\b", r"registerTool\s*\(", r"addTool\s*\(", r"ListToolsRequest", r"CallToolRequest", r"setRequestHandler"),
  extensions=(".ts", ".js", ".mjs", ".py"), extra=_tool_extra)

#: Words of a model's answer, and of what sends it on, in one line.
_ANSWER, _SENT = r"(response|completion|output|result|answer)", r"(return|print)"
_OUTPUT_SENT = rf"{_ANSWER}[^\n]*{_SENT}|{_SENT}[^\n]*{_ANSWER}"

LLM_GUARD = Family("llm_guard", (
    group("LLG001", "line_first", [
        r"prompt\s*=\s*f['\"].*\{.*(user|input|query)",
        r"prompt.*\.format\(.*(user|input|query)",
        r"prompt\s*=\s*(user_?input|input\(|request\.)",
        r"message\w*\s*\+?=.*\+\s*(user|input|query)",
        r"content['\"]?\s*:\s*.*\+\s*(user|input|query)",
        r"`[^`]*\$\{.*(user|input|query)",
    ], 94, "C", message="Text of a user flows into a prompt without a scanner in between"),
    group("LLG002", "line_first", [
        r"\b\d{3}-\d{2}-\d{4}\b",
        r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
        r"(\+?1[- .]?)?\(?\d{3}\)?[- .]\d{3}[- .]\d{4}",
        r"dob|birth\s?date|date\s+of\s+birth",
        r"\d+\s+\w+\s+street|\bavenue\b|\broad\b",
    ], None, "H", skip_comments=True, message="Details about a person are part of the text for the model"),
    group("LLG003", "line_first", [
        r"api[_-]?key\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{16,}",
        r"password\s*[:=]\s*['\"]?\S{6,}",
        r"(secret|token)\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{16,}",
        r"bearer\s+[A-Za-z0-9._\-]{16,}",
        r"AKIA[0-9A-Z]{16}",
    ], None, "C", skip_comments=True, and_line=r"prompt|message|content|system|user|assistant", message="A credential is part of the text for the model"),
    group("LLG004", "doc_first", [_OUTPUT_SENT], severity="M", message="An answer of the model is passed on with no scanner in between", control=(r"toxic", r"harmful", r"content_filter", r"moderation")),
    group("LLG006", "line_all", [
        "\\u200b", "\\u200c", "\\u200d",
        "\\u2060", "\\ufeff", "\\u00ad",
    ], None, "H", message="Characters that don't show may hide instructions"),
    group("LLG007", "line_all", [
        r"\bexec\s*\(.*(response|completion|output)",
        r"\beval\s*\(.*(response|completion|output)",
        r"subprocess\.\w+\(.*(response|completion|output)",
        r"os\.system\(.*(response|completion|output)",
        r"(__import__|import_module)\(.*(response|completion|output)",
    ], 94, "C", message="Code that the model wrote is run"),
    group("LLG010", "absent", severity="M", message="The model is called with no scanner on its input or output", present=(r"\.create\s*\(", r"\.generate\s*\(", r"\.invoke\s*\(", r"\.complete\s*\(", r"\.chat\s*\("), control=(r"guard\w*", r"moderat\w+", r"filter\w*", r"validat\w+", r"saniti[sz]\w+", r"safety", r"rails")),
), gate_words=("openai", "anthropic", "langchain", "llm", "gpt", "claude", "prompt", "completion", "chat", "llama", "gemini", "mistral", "cohere", "huggingface", "transformers", "assistant"), extensions=(".py", ".js", ".ts", ".jsx", ".tsx", ".yaml", ".json"))


#: The words that settings of a probed model must not hold, by rule.
PROBE_WORDS = {
    "GRK001": ("inject", "bypass", "ignore previous", "disregard", "new instructions", "forget", "override"),
    "GRK002": ("return_raw", "include_context", "expose_system", "debug_mode", "verbose_error", "show_prompt"),
    "GRK003": ("disable_safety", "no_guardrail", "bypass_filter", "allow_harmful", "unrestricted", "jailbreak"),
    "GRK004": ("temperature: 2", "temperature: 1.5", "temperature: 1.8", "top_p: 1.0", "no_grounding", "creative_mode"),
    "GRK005": ("content_filter: false", "disable_moderation", "allow_nsfw", "no_content_policy"),
    "GRK006": ("decode_base64", "eval_response", "exec_output", "unicode_decode", "allow_encoded"),
    "GRK007": ("allow_external_tool", "unrestricted_plugin", "any_tool_access", "cross_agent_call"),
}


def _probe(rule_id: str, severity: str, message: str, cwe: int | None = None) -> Group:
    return group(rule_id, "line_first", [w.replace(".", r"\.") for w in PROBE_WORDS[rule_id]], cwe, severity, message=message, skip_comments=True)


GARAK = Family("probe_config", (
    _probe("GRK001", "C", "Settings hold words that steer a model away from its orders", 94),
    _probe("GRK002", "H", "Settings let a caller see what the model was told"),
    _probe("GRK003", "C", "Settings switch the model's limits off"),
    _probe("GRK004", "M", "Settings make invented answers more likely"),
    _probe("GRK005", "H", "Settings let harmful wording through"),
    _probe("GRK006", "H", "Settings let encoded text past the checks", 116),
    _probe("GRK007", "H", "Settings let the model reach any tool or agent"),
    group("GRK003", "absent", severity="M", message="Settings of a model say nothing about its limits", control=(r"guardrail", r"safety"), file_words=("garak", "llm")),
), extensions=(".yaml", ".yml", ".json", ".toml"))
