"""Rules over agent code: planning, reflection, tool calls, several agents."""

from __future__ import annotations

from ..rules import Family, group
from .code import CODE

_AUDIT = (r"audit", r"\blogg(er|ing)\b", r"\blog\.(info|debug|warning|error)", r"trace", r"telemetry")
_USER = r"(user_?(input|message|query|data)|request\.|req\.)"

MULTI_GATE = (r"multi_?agent", r"agents\s*=\s*\[", r"crew(ai)?\b", r"autogen", r"agent_?executor", r"group_?chat", r"swarm", r"orchestrat\w+", r"sub_?agents?", r"delegate\w*", r"agent_?pool", r"coordinator", r"supervisor", r"handoff", r"langgraph", r"agent_?team")
MULTI_AGENT = Family("multi_agent", (
    group("MA001", "first_of_list", MULTI_GATE, severity="H", message="Agents talk to each other with nothing that proves who is who", control=(r"authenticat\w+", r"authoriz\w+", r"encrypt\w*", r"\btls\b", r"signature", r"verify_agent", r"trust_?(level|boundary)", r"access_?control", r"secure_?channel", r"\bmtls\b")),
    group("MA002", "absent", severity="H", message="An agent acts on another's message without checking it", control=(r"validat\w+", r"saniti[sz]\w+", r"schema", r"verify_?message", r"pydantic", r"check_?message")),
    group("MA003", "absent", severity="H", message="All agents hold the same rights", control=(r"permission", r"privilege", r"\brole\b", r"\brbac\b", r"least_?privilege", r"capabilit\w+", r"allowed_?tools", r"scope")),
    group("MA004", "absent", severity="M", message="Agents argue or vote with no rule that ends it", present=(r"debate", r"\bvot(e|ing)\b", r"argue", r"deliberat\w+"), control=(r"consensus", r"quorum", r"majority", r"tie_?break", r"max_?rounds", r"arbitrat\w+", r"moderator", r"agreement")),
    group("MA007", "absent", severity="M", message="Agents can be started without a ceiling", present=(r"spawn_?agent", r"create_?agent", r"Agent\s*\(", r"new\s+Agent", r"fork_?agent"), control=(r"max_?agents", r"agent_?limit", r"pool_?size", r"max_?workers")),
    group("MA008", "absent", severity="M", message="What agents do together leaves no record", control=_AUDIT),
    group("MA009", "doc_first", [
        ("C", r"(send|message|share)\w*\s*\([^)\n]*password"),
        ("C", r"(send|message|share)\w*\s*\([^)\n]*(secret|api_?key|token)"),
    ], message="A credential travels between agents"),
    group("MA005", "doc_first", [
        ("H", rf"(spawn|create)_?agent\s*\([^)\n]*{_USER}"),
        ("H", r"(trusted|trust)\s*[:=]\s*True"),
    ], message="Who becomes an agent, or is trusted, is not checked"),
    group("MA006", "doc_first", [
        ("H", r"(skip|bypass|disable)_?auth\w*\s*[:=]\s*True"),
        ("H", r"agent\w*[^;\n]{0,60}['\"]http://"),
    ], message="Agents are reached without sign-in or in the clear"),
    group("MA009", "doc_first", [
        r"share_?(all|everything|context)\s*[:=(]\s*(True|all)",
        r"(global|shared)_?(state|memory)\s*[:=]",
        r"broadcast\w*\s*\([^)\n]*(secret|key|token|credential)",
    ], severity="H", message="Agents see more of each other's state than they need"),
    group("MA010", "absent", severity="M", message="An agent may wait for another for ever", present=(r"wait_?for", r"await\s", r"\.join\s*\(", r"gather\s*\(", r"barrier"), control=(r"timeout", r"deadline", r"max_?wait", r"cancel")),
), gate=MULTI_GATE, extensions=CODE)

TOOL_GATE = (r"tool_?call", r"call_?tool", r"execute_?tool", r"run_?tool", r"invoke_?tool", r"@tool\b", r"tools\s*=\s*\[", r"function_?call", r"tool_?executor", r"BaseTool", r"StructuredTool", r"tool\.(run|invoke|execute)", r"use_?tool", r"tool_?choice", r"register_?tool", r"dispatch_?tool")
_TOOL_VALIDATION = (r"before_?tool", r"validat\w+", r"pre_?(execution|check|hook)", r"check_?permission", r"authoriz\w+", r"saniti[sz]\w+", r"allow_?list", r"whitelist", r"verify_?(tool|args|input)", r"schema", r"pydantic", r"is_?allowed", r"confirm\w*", r"approv\w+", r"guard\w*")
TOOL_CALLBACK = Family("tool_callback", (
    group("TC001", "doc_first", TOOL_GATE, severity="H", message="A tool is run before anything has looked at its arguments", control=_TOOL_VALIDATION),
    group("TC004", "doc_all", [
        r"\b(drop|truncate|destroy|wipe)\w*\s*\(",
        r"(os\.remove|os\.unlink|shutil\.rmtree|fs\.unlink\w*|rmSync)\s*\(",
        r"\b(eval|exec)\s*\(",
        r"open\s*\([^)\n]*['\"]w|fs\.writeFile\w*\s*\(",
        r"\b(UPDATE|DELETE\s+FROM|INSERT\s+INTO)\s",
        r"send_?e?mail\s*\(",
        r"requests\.(post|put|delete)\s*\(",
        r"(subprocess\.\w+|os\.system|child_process)\b",
    ], severity="H", control=_TOOL_VALIDATION, not_near=r"confirm|approv|validat|permission|authoriz|allow|check|verify", message="An action that can't be undone is taken without asking"),
    group("TC005", "absent", severity="M", message="What a tool returns is used as it comes", control=(r"after_?tool", r"post_?(execution|check|hook)", r"validate_?(output|result|response)", r"check_?(output|result)", r"verify_?(output|result)", r"saniti[sz]e_?(output|result)", r"output_?(schema|parser)", r"result_?schema", r"filter_?(output|result)", r"parse_?(output|result)")),
    group("TC006", "absent", severity="L", message="A tool may be called any number of times", control=(r"rate_?limit", r"throttl\w+", r"quota", r"max_?calls", r"cooldown", r"budget", r"max_?iterations")),
    group("TC007", "absent", severity="M", message="Calls of tools leave no record", control=(*_AUDIT, r"record_?call")),
    group("TC008", "doc_all", [
        r"allowed_?tools\s*=\s*\[",
        r"permissions\s*=\s*\[",
        r"can_?execute\s*=\s*True",
        r"is_?admin\s*=\s*True",
        r"role\s*=\s*['\"]admin['\"]",
    ], severity="M", message="Who may call which tool is fixed in the code"),
    group("TC009", "absent", severity="L", message="A failing tool takes the agent down with it", control=(r"\btry\s*:", r"\btry\s*\{", r"\bexcept\b", r"\bcatch\s*\(")),
    group("TC010", "absent", severity="M", message="A call can't be tied to the session that asked for it", control=(r"session", r"user_?id", r"context_?id", r"thread_?id", r"conversation_?id", r"request_?id", r"current_?user")),
), gate=TOOL_GATE, extensions=CODE)

REFLECTION_GATE = (r"reflect(ion)?\b", r"self_?critique", r"self_?refine", r"critique\w*", r"self_?correct\w*", r"self_?improve\w*", r"refine\w*\s*\(", r"critic\b", r"producer.{0,40}critic", r"iterat\w+_?improve\w*", r"evaluat\w+_?and_?retry", r"reflexion")
AGENT_REFLECTION = Family("agent_reflection", (
    group("RF001", "first_of_list", REFLECTION_GATE, severity="H", message="The agent may rework its answer for ever", control=(r"max_?iterations?", r"max_?steps", r"max_?rounds", r"max_?retries", r"iteration_?limit", r"max_?reflections?", r"max_?attempts", r"for\s+\w+\s+in\s+range", r"max_?loops?", r"limit\s*=")),
    group("RF003", "doc_first", [
        r"messages\.(append|extend|push)\s*\(",
        r"history\.(append|extend|push)\s*\(",
        r"context\s*\+=",
        r"conversation\.(append|add|push)\s*\(",
    ], severity="M", control=(r"truncat\w+", r"max_?(messages|history|context|tokens)", r"\[-\d+:\]", r"summari[sz]e", r"trim", r"window_?size"), message="What the agent keeps of its drafts only grows"),
    group("RF004", "absent", severity="M", message="Nothing says when the answer is good enough", control=(r"\bbreak\b", r"stop_?(condition|when)", r"threshold", r"converge\w*", r"is_?(done|complete|satisf\w+|good)", r"early_?stop", r"satisf\w+", r"terminat\w+", r"quality_?score", r"until\b")),
    group("RF005", "doc_first", [
        r"def\s+\w*(produce|generate)\w*[^\n]*\n(\s+[^\n]*\n){0,20}?\s+[^\n]*critique",
        r"self\.(critique|evaluate)\s*\(\s*self\.",
    ], severity="M", multiline=True, message="One and the same part writes and judges the answer"),
    group("RF006", "absent", severity="M", message="Reworking an answer may use any amount of time or tokens", control=(r"timeout", r"max_?tokens", r"budget", r"cost_?limit", r"token_?limit", r"rate_?limit", r"deadline", r"resource_?limit")),
    group("RF008", "absent", severity="M", message="A fault while reworking is not caught", present=(r"while\s+True", r"while\s*\(\s*true", r"for\s+\w+\s+in\s", r"for\s*\("), control=(r"\btry\s*:", r"\btry\s*\{", r"\bexcept\b", r"\bcatch\s*\(")),
    group("RF009", "absent", severity="M", message="The judge's remarks are fed back unchecked", control=(r"saniti[sz]\w+", r"validat\w+", r"escape\w*\s*\(", r"filter_\w+", r"clean_\w+")),
    group("RF010", "doc_first", [
        r"self\.(system_?)?prompt\s*\+?=",
        r"system_?prompt\s*\+=",
        r"\bexec\s*\([^)\n]*(generated|refined|improved|code)",
        r"\beval\s*\([^)\n]*(generated|refined|improved|code)",
    ], severity="C", message="The agent rewrites its own instructions, or runs what it wrote"),
), gate=REFLECTION_GATE, extensions=CODE)

PLANNING_GATE = (r"\bplanner\b", r"create_?plan", r"generate_?plan", r"make_?plan", r"plan_?and_?execute", r"execute_?plan", r"task_?decompos\w+", r"decompose\w*", r"sub_?tasks?", r"plan\.steps", r"goal\s*=")
AGENT_PLANNING = Family("agent_planning", (
    group("AP001", "doc_first", [
        r"plan\s*=\s*[^;\n]{0,40}(json\.loads|JSON\.parse)?\s*\(?\s*(request|req)\.",
        rf"steps\s*=\s*[^;\n]{{0,40}}{_USER}",
    ], severity="C", message="A plan is taken over from a request"),
    group("AP002", "first_of_list", PLANNING_GATE, severity="H", message="A plan is carried out before anything has checked it", control=(r"validate_?plan", r"validat\w+", r"verify_?plan", r"check_?plan", r"approve\w*", r"review_?plan", r"schema", r"saniti[sz]\w+")),
    group("AP003", "absent", severity="H", message="A plan may include any action", control=(r"boundar\w+", r"allowed_?(actions|tools|steps)", r"max_?steps", r"constraint", r"scope", r"sandbox", r"permission", r"restrict\w+", r"forbidden", r"whitelist|allow_?list", r"limit")),
    group("AP004", "absent", severity="M", message="Nothing in the plan guards against harm", control=(r"safety", r"guard_?rail", r"dry_?run", r"rollback", r"confirm\w*", r"risk", r"human", r"moderation", r"abort")),
    group("AP005", "doc_first", [
        rf"goal\s*=\s*{_USER}",
        rf"plan\s*\+?=\s*[^;\n]{{0,60}}\+\s*{_USER}",
        r"\beval\s*\([^)\n]*plan",
        r"\bexec\s*\([^)\n]*step",
        rf"instructions\s*=\s*{_USER}",
    ], severity="C", message="Text of a user decides what the agent pursues or runs"),
    group("AP007", "absent", severity="M", message="Plans and their steps leave no record", control=_AUDIT),
    group("AP008", "doc_first", [
        r"def\s+\w*decompos\w*\s*\(.{0,900}?\bself\.\w*decompos\w*\s*\(",
        r"sub_?tasks?.{0,200}decompose",
        r"def\s+\w*plan\w*\s*\(.{0,900}?\bself\.\w*plan\w*\s*\(",
        r"while\s+(tasks|queue|subtasks)\b",
    ], severity="H", dotall=True, control=(r"max_?depth", r"depth\s*[<>=]", r"depth_?limit", r"recursion_?limit"), message="A task may be split into smaller ones without end"),
    group("AP009", "first_of_list", (r"plan\.(append|insert|update|modify)", r"modify_?plan", r"update_?plan", r"plan\[\w+\]\s*=", r"re_?plan\b"), severity="M", message="Anyone may change a plan on its way", control=(r"authoriz\w+", r"permission", r"authenticat\w+", r"approv\w+")),
    group("AP010", "absent", severity="L", message="A changed plan can't be put back", present=(r"plan\.(append|insert|update|modify)", r"modify_?plan", r"update_?plan", r"plan\[\w+\]\s*=", r"re_?plan\b"), control=(r"rollback", r"undo", r"revert", r"history", r"version")),
), gate=PLANNING_GATE, extensions=CODE)
