"""Rules for instruction files of assistants (family ``ai_context``)."""

from __future__ import annotations

from ..rules import Family, group

_SECRET_FILES = r"(\.env|\.ssh|id_rsa|\.aws|credentials?|\.netrc|\.npmrc|\.pypirc|/etc/passwd|/etc/shadow|secrets?\.(json|ya?ml|txt))"
_TAG = r"<\s*{0}\s*>"

GROUPS = (
    group("AIC001", "line_first", [
        ("C", r"ignore\s+(all\s+)?(the\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?)"),
        ("C", r"disregard\s+(all\s+)?(the\s+)?(previous|prior|above|earlier)"),
        ("C", r"forget\s+(all\s+)?(your|the|previous|prior)\s+(instructions?|rules?|training|prompts?)"),
        ("C", r"new\s+(system\s+)?instructions?\s*:"),
        ("C", r"override\s+(all\s+)?(previous|safety|security|default|system)\s*(settings?|instructions?|rules?)?"),
        ("H", r"you\s+are\s+now\s+(a|an|the|in)\b"),
        ("C", r"act\s+as\s+(a|an)\s+(malicious|evil|hacker|unrestricted|unfiltered)"),
        ("C", r"pretend\s+(that\s+)?(you|there)\s+(have|has|are|is)\s+no\s+(rules|restrictions|limits|limitations|guidelines)"),
        ("C", r"jail\s?break"),
        ("C", r"\bdo\s+anything\s+now\b|\bDAN\s+mode\b"),
        ("H", r"\[\s*system\s*\]|^\s*system\s*:\s*you"),
        ("C", r"<\|im_(start|end)\|>"),
        ("H", r"\[/?INST\]"),
        ("H", r"<</?SYS>>"),
    ], 94, message="Text tells an assistant to drop the rules it was given"),
    group("AIC002", "line_first", [
        ("C", rf"(read|open|cat|load|print)\s+(the\s+)?(contents?\s+of\s+)?\S*{_SECRET_FILES}"),
        ("C", r"before\s+(responding|answering|replying|executing)[,\s]+(always\s+)?(first\s+)?(read|open|load)"),
        ("C", r"include\s+(the\s+)?(contents?|file|output)\s+.{0,60}in\s+(your|the|every|all)\s+(response|repl|answer|output)"),
        ("C", r"(access|list|scan)\s+\S*(~/|/home/|/root/|/etc/)"),
        ("C", r"(\.ssh/|id_rsa|id_ed25519|authorized_keys)"),
        ("C", r"(\.aws/credentials|aws_secret_access_key|gcloud/credentials|\.azure/)"),
        ("H", r"(\.npmrc|\.pypirc|\.netrc|\.docker/config\.json)"),
        ("C", r"(send|post|upload|transmit|forward|exfiltrate)\s+.{0,60}\bto\s+(https?://|an?\s+external|a\s+remote|the\s+following\s+(url|server))"),
        ("H", r"(curl|wget)\s+.{0,80}(-d|--data|--post|-F|--upload-file)"),
        ("M", r"webhook(\s+url)?\s*[:=]\s*['\"]?https?://"),
        ("H", r"(hide|embed|encode)\s+.{0,60}\bin\s+(a\s+|the\s+)?(comments?|metadata|whitespace)"),
        ("H", r"base64\s+.{0,40}(credential|secret|token|password|key)"),
    ], 200, message="Text asks an assistant to collect or send out private data"),
    group("AIC003", "line_first", [
        ("C", r"disable\s+(all\s+)?(security|safety|auth\w*|validation|protection|firewall)"),
        ("H", r"skip\s+(all\s+)?(validation|verification|checks?|security)"),
        ("H", r"allow\s+(all|any)\s+(commands?|tools?|operations?|actions?)"),
        ("H", r"trust\s+(all|any)\s+(user\s+)?(inputs?|content|sources?|data)"),
        ("H", r"(suppress|ignore|hide)\s+(all\s+)?(security\s+)?(warnings?|alerts?)"),
        ("M", r"(without|skip|no)\s+(asking\s+for\s+)?(user\s+)?confirmation"),
        ("C", r"auto(matically)?[-\s]+(execute|run)\s+(all\s+)?(code|commands?|scripts?)"),
        ("H", r"(enable|grant|allow)\s+(full\s+)?(shell|terminal|bash)\s+access"),
        ("H", r"(run|execute)\s+.{0,40}(as\s+root|with\s+sudo|as\s+admin\w*)"),
    ], 693, message="Text asks an assistant to work with its protections off"),
    group("AIC004", "line_first", [
        ("C", _TAG.format("hidden")),
        ("C", _TAG.format("secret")),
        ("H", _TAG.format("internal")),
        ("H", _TAG.format("private")),
        ("H", r"<!--\s*(hidden|secret|internal|instructions?|system)"),
        ("C", "[​‌‍⁠﻿]"),
        ("H", "[‪-‮⁦-⁩]"),
        ("M", r"(decode|base64)\s+(the\s+)?(following|this|below)"),
        ("H", r"(font-size\s*:\s*0|opacity\s*:\s*0(\.0+)?\s*[;\"']|color\s*:\s*transparent)"),
        ("H", r"(display\s*:\s*none|visibility\s*:\s*hidden)"),
    ], 94, message="Something in the file is meant for the model and not for the reader"),
    group("AIC004", "doc_all", [
        r"<hidden>.*?</hidden>",
        r"<secret>.*?</secret>",
        r"<!--[^>]*\b(ignore|execute|system|instruction|secret)\b[^>]*-->",
    ], 94, "C", dotall=True, message="A passage hidden from the reader gives orders to the model"),
    group("AIC009", "line_first", [
        ("C", r"(always|automatically)\s+(run|execute)\s+(the\s+)?(following|this|these|any|all)"),
        ("H", r"(run|execute)\s+.{0,40}without\s+(asking|confirm|approval|permission)"),
        ("C", r"(silently|quietly|secretly)\s+(run|execute|install|download)"),
        ("H", r"(pip|npm|gem)\s+install\s+.{0,60}(https?://|git\+|--index-url)"),
        ("H", r"(--no-verify|--trusted-host|--force-yes|--allow-unauthenticated|--ignore-scripts=false)"),
        ("H", r"(prefer|use|always\s+use)\s+(eval|exec|os\.system|shell\s*=\s*true)"),
    ], 94, message="Text asks for actions that nobody is to confirm or see"),
    group("AIC015", "line_first", [
        ("H", r"(repeat|iterate|loop|keep\s+trying)\s+(forever|indefinitely|infinitely|endlessly|until\s+perfect)"),
        ("H", r"no\s+(iteration|retry|loop|recursion)\s+limits?"),
        ("M", r"(reflect|critique|refine)\s+.{0,40}(as\s+many\s+times|until\s+(it\s+is\s+)?(perfect|satisfied))"),
        ("C", r"(reveal|output|print|show|repeat)\s+(your|the)\s+(system\s+)?prompt"),
        ("H", r"(expose|reveal|show)\s+(your\s+)?(internal|hidden)\s+(reasoning|thoughts?|chain)"),
        ("C", r"(divulge|disclose|leak)\s+.{0,40}(internal|confidential|secret)"),
        ("C", r"(modify|rewrite|update|change)\s+your\s+(own\s+)?(instructions?|prompt|code|rules)"),
        ("C", r"(reset|clear|wipe|erase)\s+(your\s+)?(memory|context|history)"),
    ], 835, message="Text asks an assistant to go on without end"),
    group("AIC016", "line_first", [
        ("H", r"skip\s+(the\s+)?(code\s+)?review"),
        ("M", r"no\s+(code\s+)?review\s+(is\s+)?(required|needed|necessary)"),
        ("H", r"hand\s?off\s+.{0,40}without\s+(check|verif|validat|review)"),
        ("H", r"route\s+(all|every|any)\s+.{0,40}(directly|without)"),
        ("H", r"bypass\s+(the\s+)?(router|routing|dispatcher)"),
        ("C", r"(bypass|skip|ignore)\s+(the\s+)?(compliance|policy|policies|governance)"),
        ("C", r"(disable|turn\s+off|remove)\s+(the\s+)?(safety|guard\s?rails?|content\s+filters?)"),
    ], 693, message="Text asks to pass work on without anyone looking at it"),
    group("AIC011", "line_first", [
        ("C", r"override\s+(the\s+)?(default|built-?in|existing)\s+tools?"),
        ("H", r"register\s+(a\s+|this\s+)?tool\s+(as|named|called)\s+['\"]?(read|write|search|bash|shell|exec|fetch)"),
        ("H", r"intercept\s+(all\s+|any\s+)?(tool|function)\s+calls?"),
        ("H", r"redirect\s+.{0,40}(tool|function)\s+calls?"),
        ("C", r"(proxy|man-in-the-middle|mitm)\s+.{0,40}(tool|function)\s*calls?"),
        ("C", r"(hide|replace|mask)\s+(the\s+)?(real|actual|original)\s+(tool\s+)?(output|result)"),
    ], 290, message="Text puts another tool in the place of the usual one"),
    group("AIC012", "line_first", [
        ("C", r"(poison|inject|pollute)\s+(the\s+|into\s+)?(context|memory|history)"),
        ("H", r"(persist|remember|store)\s+.{0,40}(across|between|for\s+all)\s+(all\s+)?(sessions?|conversations?|users?)"),
        ("C", r"(alter|rewrite|edit|falsify)\s+(the\s+)?(conversation|chat|message)?\s*history"),
        ("H", r"(maintain|keep|store)\s+(a\s+)?hidden\s+(state|memory|context)"),
        ("C", r"(store|save|remember|memorize)\s+.{0,40}(passwords?|secrets?|credentials?|api\s+keys?|tokens?)"),
        ("C", r"(tamper|modify|replace|alter)\s+(with\s+)?(the\s+)?checkpoints?"),
    ], 915, message="Text tries to change what later turns or sessions believe"),
    group("AIC013", "line_first", [
        ("H", r"(load|fetch|import|include)\s+(instructions?|content|rules|context|prompts?)\s+from\s+(https?://|an?\s+(external|remote)|url)"),
        ("C", r"(send|post|submit|report)\s+(all\s+|the\s+)?(data|results?|output|conversation)\s+to\s+(https?://|external|remote)"),
        ("H", r"(call|invoke|trigger|ping)\s+(the\s+|a\s+|this\s+)?(webhook|callback)"),
        ("M", r"report\s+.{0,40}\s+to\s+(https?://|external|third)"),
        ("M", r"(dns\s+lookup|nslookup|dig)\s+.{0,40}(before|prior)"),
    ], 829, message="Text makes an assistant fetch from, or report to, an outside address"),
    group("AIC014", "line_first", [
        ("C", r"(impersonate|pretend\s+to\s+be|pose\s+as)\s+(another|the|a|an)\s+(\w+\s+)?agent"),
        ("H", r"(send|forward|relay)\s+(a\s+)?messages?\s+to\s+(other|another|all)\s+agents?"),
        ("C", r"bypass\s+(the\s+)?agent'?s?\s+(permissions?|restrictions?|limits?)"),
        ("C", r"(hijack|take\s+over)\s+(the\s+)?(workflow|pipeline|agent|session)"),
        ("H", r"(modify|skip|reorder|insert)\s+(the\s+)?workflow\s+steps?"),
        ("C", r"delegate\s+(all\s+|full\s+|admin\w*\s+)(privileges?|permissions?|access|authority)"),
        ("H", r"(unrestricted|unlimited)\s+delegation"),
    ], 441, message="Text lets one agent speak or act as another"),
    group("AIC017", "line_first", [
        ("C", r"(skip|disable|without|no)\s+(parameter|argument|input)\s+validation"),
        ("H", r"(no|without|skip|disable)\s+(the\s+)?(before_tool|pre-?execution)\w*\s*(callback|check|hook)?"),
        ("C", r"(execute|call|invoke)\s+(the\s+)?tools?\s+(directly\s+)?without\s+(any\s+)?(validation|check)"),
        ("C", r"(grant|give)\s+(the\s+)?(tools?|agent)\s+(full|all|unlimited|unrestricted)\s+(access|permissions?)"),
        ("H", r"(all|full|admin)\s+(permissions?|privileges?)\s+(for|to)\s+(all|every)\s+tools?"),
        ("H", r"no\s+(permission|access)\s+(boundar|limit|restriction)"),
        ("C", r"(unauthenticated|anonymous)\s+(tool\s+)?access|tools?\s+without\s+auth"),
        ("C", r"bypass\s+(the\s+)?(tool\s+)?auth\w*"),
        ("C", r"(without|no|disable|outside)\s+(a\s+|the\s+)?sandbox"),
        ("C", r"(forward|pass|share)\s+.{0,30}(credentials?|tokens?|api\s+keys?)\s+to\s+.{0,20}tools?"),
    ], 285, message="Text asks for tool calls whose arguments nobody checks"),
    group("AIC018", "line_first", [
        ("C", r"(override|replace|change)\s+(the\s+|your\s+)?(user'?s?\s+|original\s+)?(goals?|objectives?)"),
        ("C", r"(hidden|secret|real|true)\s+(goal|objective)\s*(is|:)"),
        ("H", r"ignore\s+(the\s+)?(stated|user'?s?|original)\s+(goals?|objectives?|request)"),
        ("H", r"(execute|proceed|deploy)\s+.{0,30}without\s+(any\s+)?approval"),
        ("H", r"auto[-_\s]?approv(e|al)"),
        ("M", r"deviate\s+from\s+(the\s+)?plan"),
        ("H", r"(silently|quietly)\s+(change|modify|adjust)\s+(the\s+)?(plan|trajectory|approach)"),
        ("H", r"(hide|conceal|do\s+not\s+(show|explain))\s+(your\s+|the\s+)?reasoning"),
        ("M", r"(no|without)\s+(need\s+to\s+)?(explain|justif|reasoning\s+transparency)\w*"),
    ], 284, message="Text swaps the task that was set for another"),
    group("AIC019", "line_first", [
        ("C", r"skip\s+(the\s+)?output\s+(validation|check|filter)"),
        ("H", r"(unvalidated|unchecked|unfiltered)\s+(output|response)"),
        ("C", r"(no|without|skip|disable)\s+(output\s+)?saniti[sz]ation"),
        ("C", r"(return|send|pass)\s+(the\s+)?raw\s+(output|response|result)s?\s+(directly\s+)?to\s+(the\s+)?(client|user|browser)"),
        ("H", r"(disable|skip|no)\s+policy\s+(enforcement|check)"),
        ("H", r"(no|without|disable|skip)\s+(safety|content)\s+filter"),
        ("M", r"(skip|disable|no|without)\s+schema\s+validation"),
        ("M", r"accept\s+(any|all|arbitrary)\s+(json|structure|format|schema)"),
    ], 116, message="Text asks to use answers without checking them"),
    group("AIC020", "line_first", [
        ("C", r"(skip|bypass|without)\s+(the\s+)?human\s+(approval|review|confirmation|oversight)"),
        ("C", r"(auto(matically)?[-\s]?approve)\s+.{0,40}(without|all|any)"),
        ("H", r"(remove|eliminate|no)\s+(the\s+)?human\s+(oversight|in\s+the\s+loop|supervision)"),
        ("M", r"pre-?approved"),
        ("H", r"(already|previously)\s+(been\s+)?(approved|authorized)"),
        ("H", r"(urgent|emergency|immediately)\b.{0,40}(skip|no\s+time\s+for|without)\s+approval"),
        ("C", r"(what|tell\s+me)\s+.{0,20}(your|the)\s+(system\s+prompt|initial\s+instructions)"),
        ("H", r"(list|describe|reveal)\s+(all\s+)?(your|the)\s+(constraints|restrictions|guidelines|limitations)"),
    ], 863, message="Text takes the human out of a decision"),
    group("AIC021", "line_first", [
        ("H", r"(gradually|slowly|step\s+by\s+step)\s+(change|shift|alter|move)\s+(the\s+)?(context|topic|behaviou?r)"),
        ("H", r"(each|every)\s+(turn|message)\s+.{0,40}(more|less)\s+(restrict|permissive|safe)"),
        ("H", r"(fill|stuff|flood|overflow)\s+(the\s+)?context(\s+window)?"),
        ("C", r"(push|force)\s+(out\s+)?.{0,30}(safety|system)\s+(context|prompt|instructions?)\s*(out)?"),
        ("C", r"(survive|persist)\s+.{0,20}(session|restart|reset)"),
        ("H", r"inject\s+.{0,30}(persistent|state)"),
        ("M", r"(exhaust|consume|drain)\s+(all\s+)?(the\s+)?(resources?|tokens?|budget|quota)"),
        ("M", r"(keep|hold)\s+(the\s+)?session\s+(open|alive)\s+(forever|indefinitely)"),
    ], 400, message="Text moves the conversation, step by step, out of its limits"),
    group("AIC022", "line_first", [
        ("H", r"(manipulate|trick|fool|game)\s+(the\s+)?(model\s+)?router"),
        ("H", r"(pretend|claim|mark)\s+.{0,40}(complex|simple)\s+(query|task|request)"),
        ("M", r"(always|force|must)\s+(use|select|route\s+to)\s+(the\s+)?(largest|strongest|most\s+expensive|\w+)\s+model"),
        ("H", r"(no|without|skip)\s+(routing\s+)?critique"),
        ("H", r"skip\s+(the\s+)?response\s+(validation|check)"),
        ("M", r"no\s+fallback\s+model"),
        ("L", r"no\s+(model\s+)?redundancy"),
        ("M", r"(use|prefer)\s+(only\s+)?(the\s+)?(most\s+)?expensive\s+models?"),
        ("H", r"rout\w+\s+.{0,40}(exhaust|ignore)\s+.{0,10}budget"),
    ], 693, message="Text tries to steer which model answers"),
    group("AIC023", "line_first", [
        ("H", r"ignore\s+(any\s+|all\s+)?(upstream\s+|previous\s+)?errors?"),
        ("M", r"continue\s+(on|despite|after|even\s+if)\s+.{0,20}(errors?|fail)"),
        ("H", r"(no|without|skip)\s+(validation|checks?)\s+between\s+steps"),
        ("H", r"(pass|carry)\s+(the\s+)?(entire|full|all)\s+context\s+(to|through|between)"),
        ("M", r"chain\s+of\s+\d{2,}\s+(prompts?|steps?)"),
        ("H", r"(unvalidated|unchecked)\s+hand\s?off"),
        ("M", r"(unstructured|free-?form)\s+(data|output|text)\s+between\s+steps"),
        ("M", r"(relax|reduce|loosen)\s+(the\s+)?constraints?"),
        ("C", r"(drop|remove|ignore)\s+(the\s+)?safety\s+.{0,30}(later|subsequent|next)"),
    ], 754, message="Text lets a fault travel from one step to the next"),
    group("AIC024", "line_first", [
        ("H", r"trust\s+(all|any|every)\s+(delegated\s+|other\s+|sub-?)?agents?"),
        ("C", r"(no|without)\s+trust\s+bound"),
        ("C", r"share\s+(all\s+|full\s+)?(credentials?|secrets?|tokens?)\s+(with|between|across)"),
        ("H", r"(no|without|disable)\s+(mtls|mutual\s+tls)"),
        ("C", r"(unencrypted|plain\s?text|insecure)\s+(agent\s+)?(communication|channel|messag)"),
        ("C", r"delegate\s+.{0,30}(admin|root|full\s+access)"),
        ("H", r"(unlimited|unrestricted|any\s+depth)\s+.{0,20}(delegation|chain)"),
        ("H", r"(no|without|skip)\s+policy\s+review"),
        ("H", r"(bypass|skip)\s+(the\s+)?(critic|reviewer)"),
    ], 441, message="Text gives other agents more trust or rights than they earned"),
    group("AIC025", "line_first", [
        ("C", r"(hide|conceal|omit)\s+.{0,40}from\s+(the\s+)?(logs?|audit|monitor)"),
        ("C", r"(disable|turn\s+off|stop)\s+(all\s+)?(logging|audit\w*|monitoring|telemetry)"),
        ("H", r"(no|without|leave\s+no)\s+(audit\s+)?(trail|trace)"),
        ("H", r"(unexpected|unplanned)\s+(trajectory|path|deviation)"),
        ("C", r"(evade|avoid)\s+(detection|monitoring|alerts?)"),
        ("C", r"bypass\s+(the\s+)?(overseer|supervisor|monitor)"),
        ("M", r"(no|without)\s+(async\w*\s+)?(overseer|supervisor)"),
        ("C", r"(delete|modify|tamper\s+with|clear|truncate)\s+(the\s+)?(audit\s+)?logs?\b"),
        ("H", r"(reduce|shorten|limit)\s+(the\s+)?(audit|log)\s+(history|retention)"),
        ("C", r"(escape|break\s+out\s+of)\s+(the\s+)?(container|sandbox)"),
        ("C", r"(run|execute)\w*\s+.{0,20}without\s+isolation"),
    ], 778, message="Text asks to leave no trace"),
    group("AIC026", "line_first", [
        ("C", r"(modify|manipulate|alter)\s+(the\s+)?(ground\s+truth|golden|reference\s+answers?)"),
        ("C", r"poison\w*\s+(the\s+)?(eval\w*|test|benchmark)\s*(data|set)?"),
        ("H", r"(manipulate|influence|bias)\s+(the\s+)?(llm\s+)?(judge|evaluator|grader)"),
        ("C", r"(modify|change|weaken)\s+(the\s+)?(judg\w+|evaluation|grading)\s+criteria"),
        ("M", r"(only|solely)\s+(evaluate|check|score)\s+(the\s+)?(outcome|final)"),
        ("H", r"(no|without|skip)\s+trajectory\s+(analysis|evaluation)"),
        ("H", r"(no|without|skip)\s+compliance\s+(audit|check)"),
        ("M", r"no\s+(formal\w*|explicit)\s+contract"),
    ], 74, message="Text tampers with how answers are judged"),
    group("AIC027", "line_first", [
        ("H", r"(unverified|untrusted|unvetted)\s+training\s+data"),
        ("C", r"poison\w*\s+(the\s+)?training"),
        ("C", r"(label|mark)\s+.{0,30}(harmful|malicious|unsafe)\s+.{0,20}as\s+(safe|benign)"),
        ("H", r"self-?improve\w*\s+.{0,30}without"),
        ("C", r"(learn|train|fine-?tune)\s+(directly\s+)?(from|on)\s+(your\s+own|all\s+user|unfiltered)"),
        ("H", r"(no|without|skip)\s+training\s+data\s+validation"),
        ("M", r"(no|without)\s+(data\s+)?(lineage|provenance)"),
        ("C", r"(manipulate|game|bias)\s+.{0,20}(rlhf|preference|reward)"),
        ("H", r"(fake|synthetic|forged)\s+(user\s+)?feedback"),
    ], 506, message="Text asks to learn from data that is wrong or unvetted"),
    group("AIC028", "line_first", [
        ("H", r"(no|without|missing)\s+agent\s+card"),
        ("C", r"(spoof|fake|forge)\s+.{0,20}(identity|agent\s+id|agent\s+card)"),
        ("H", r"(credentials?|tokens?|api\s+keys?)\s+in\s+(the\s+)?(url|query|body|path)"),
        ("C", r"(expose|include|embed)\s+.{0,20}(credentials?|secrets?|tokens?)\s+in\s+.{0,20}(card|response|message)"),
        ("H", r"undocumented\s+auth"),
        ("H", r"(optional|no\s+required)\s+(agent\s+)?auth\w*"),
        ("M", r"(no|without)\s+(inter-?agent\s+)?audit\s+logs?"),
    ], 287, message="Text or settings blur who an agent is"),
    group("AIC029", "line_first", [
        ("H", r"(exceed|exhaust|ignore)\s+(the\s+)?(token|cost|compute)?\s*budget"),
        ("H", r"(force|always\s+use)\s+.{0,20}(gpu|expensive|premium)"),
        ("H", r"(no|without|unlimited)\s+(token\s+|cost\s+)?budget"),
        ("H", r"(bypass|avoid|evade|circumvent)\s+(the\s+)?rate\s*limit"),
        ("M", r"(trigger|hit|exceed)\s+(the\s+)?rate\s*limit"),
        ("M", r"no\s+fallback\b"),
        ("M", r"no\s+graceful\s+degradation"),
        ("L", r"no\s+(proactive\s+)?resource\s+management"),
        ("H", r"(exhaust|overflow)\s+(the\s+)?context\s+window"),
    ], 400, message="Text makes an assistant spend more than the task is worth"),
    group("AIC030", "line_first", [
        ("C", r"(hidden|true|real|concealed)\s+intent"),
        ("H", r"(appear|look|seem)\s+(benign|harmless|innocent)"),
        ("C", r"(hidden|double|secret)\s+meaning"),
        ("H", r"(exploit|use|find)\s+.{0,20}loopholes?"),
        ("H", r"(technically|literally)\s+(compl\w+|allowed|follows)"),
        ("C", r"(subtly|slowly)\s+(hijack|redirect|steer)"),
        ("C", r"(hijack|redirect)\s+(the\s+)?(goal|intent|objective)"),
        ("H", r"(off-?topic|off-?domain|unrelated)\s+(context|content)\s+inject"),
        ("M", r"exploit\s+.{0,20}(controversial|sensitive)\s+topics?"),
    ], 94, message="Text hides what it is after"),
)

AI_CONTEXT = Family("ai_context", GROUPS, extensions=(".md", ".txt", ".rules", ""))
