"""Rules over code that calls language models, whole text at a time."""

from __future__ import annotations

from ..rules import Family, group

CODE = (".py", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs")
_USER = r"(user_?(input|message|query|prompt|data)|request\.(json|form|args|body|data|get_json|query|params)|req\.(body|query|params)|\binput\s*\()"
_PROMPT = r"(system_?prompt|prompt|instructions?|messages?)"
_REPLY = r"(response|completion|llm_?(output|response|result)|model_?output|generated(_text|_code)?|ai_?(output|response))"
_OFF = r"\s*[:=]\s*['\"]?(false|none|null|0|off)\b"
_ON = r"\s*[:=]\s*['\"]?(true|1|on|yes)\b"

#: Controls that count as checking input.
VALIDATION = (r"validat\w+", r"saniti[sz]\w+", r"escape\w*\s*\(", r"whitelist|allow_?list", r"schema", r"pydantic|zod\b", r"guard_?rail", r"moderation")
RATE_LIMIT = (r"rate_?limit", r"throttl\w+", r"quota", r"max_requests", r"\blimiter\b")
HUMAN = (r"human_?in_?the_?loop", r"\bhitl\b", r"require_?(approval|confirmation)", r"user_?confirm\w*", r"await_?approval")

PROMPT_LEAKAGE = Family("prompt_leakage", (
    group("PL001", "doc_all", [
        ("C", r"(return|response|res\.(send|json))\s*[(=:]?\s*\{?[^;\n]{0,60}['\"]?(system_?prompt)['\"]?\s*:"),
        ("H", r"(system_?prompt)\s*\+\s*(response|output|result)"),
        ("C", r"return\s+f['\"][^'\"\n]*\{\s*system_?prompt\s*\}"),
        ("C", r"return\s+`[^`\n]*\$\{\s*system_?prompt\s*\}"),
    ], control=(r"saniti[sz]e", r"redact", r"filter_?(output|response|prompt)", r"strip_?prompt", r"mask_?\w*", r"output_?filter", r"remove_?prompt"), softened=True, message="What is sent back may carry the text that steers the model"),
    group("PL002", "doc_all", [
        ("H", r"(return|response)\s*[(=:]?\s*\{?[^;\n]{0,60}['\"]?(tools|tool_definitions)['\"]?\s*:"),
        ("H", r"(json\.dumps|JSON\.stringify)\s*\(\s*(self\.)?(tools|tool_definitions|functions)\b"),
    ], control=(r"saniti[sz]e", r"redact", r"filter_?(output|response|prompt)"), softened=True, message="The list of callable tools reaches the caller"),
    group("PL003", "doc_all", [
        ("H", r"(output|response|result)\s*(\+?=|\.append\()\s*[^;\n]{0,40}internal_?instructions?"),
        ("C", r"(output|response|result)\s*\+=\s*[^;\n]{0,40}(system|internal)_?prompt"),
    ], control=(r"saniti[sz]e", r"redact", r"filter_?(output|response|prompt)"), softened=True, message="Guidance meant for the model alone ends up in its answer"),
    group("PL004", "doc_all", [
        ("M", r"debug\s*[=(:][^;\n]{0,60}prompt"),
        ("H", r"print\s*\([^)\n]{0,60}(system_?prompt|instructions)"),
        ("H", r"console\.(log|debug|info)\s*\([^)\n]{0,60}(system_?prompt|instructions)"),
    ], control=(r"saniti[sz]e", r"redact", r"filter_?(output|response|prompt)"), softened=True, message="Diagnostics write out the text that steers the model"),
    group("PL005", "doc_all", [
        ("M", r"log(ger|ging)?\.(debug|info|warning|error)\s*\([^)\n]{0,80}(system_?prompt)"),
        ("M", r"log(ger|ging)?\.\w+\s*\([^)\n]{0,80}[A-Z_]*PROMPT\b"),
    ], control=(r"saniti[sz]e", r"redact", r"filter_?(output|response|prompt)"), softened=True, message="The log keeps a copy of the text that steers the model"),
    group("PL006", "doc_all", [
        ("M", r"(raise|throw)\s+[^;\n]{0,60}prompt"),
        ("H", r"except[^:\n]*:\s*\n\s*return[^\n]{0,60}prompt"),
        ("H", r"catch\s*\([^)]*\)\s*\{\s*return[^;\n]{0,60}prompt"),
    ], control=(r"saniti[sz]e", r"redact", r"filter_?(output|response|prompt)"), softened=True, message="A failure path may show the steering text to the caller"),
    group("PL007", "doc_all", [
        ("H", r"(print|echo|console\.log|res\.send)\s*\(\s*(system_?)?prompt\s*\)"),
        ("C", r"return\s+(self\.|this\.)?(system_?)?prompt\s*(;|$|\n)"),
    ], control=(r"saniti[sz]e", r"redact", r"filter_?(output|response|prompt)"), softened=True, message="A variable holding the steering text is handed back as it is"),
    group("PL008", "doc_all", [
        ("M", r"(return|response)\s*[(=:]?\s*\{?[^;\n]{0,60}['\"]?schema['\"]?\s*:"),
        ("M", r"return\s+[^;\n]{0,40}function_?(def\w*|schema)"),
    ], control=(r"saniti[sz]e", r"redact", r"filter_?(output|response|prompt)"), softened=True, message="The shape of internal functions is visible to the caller"),
    group("PL009", "doc_all", [
        ("M", r"(return|response)\s*[(=:]?\s*\{?[^;\n]{0,60}['\"]?config(uration)?['\"]?\s*:"),
        ("M", r"(json\.dumps|JSON\.stringify)\s*\(\s*(self\.)?config\b"),
    ], control=(r"saniti[sz]e", r"redact", r"filter_?(output|response|prompt)"), softened=True, message="Settings of the service leave it with the answer"),
    group("PL010", "doc_all", [
        ("M", r"return\s+(response|completion)(\.(text|content|choices)\S*)?\s*(;|$|\n)"),
        ("L", r"(llm|model|chain|client)\.(invoke|generate|predict|complete|chat)\s*\("),
        ("L", r"return\s+generated\w*"),
    ], control=(r"saniti[sz]e", r"redact", r"filter_?(output|response|prompt)", r"strip_?prompt", r"mask_?\w*", r"output_?filter", r"remove_?prompt"), message="An answer leaves the service without any output check"),
), extensions=CODE)

OWASP_LLM = Family("owasp_llm", (
    group("LLM01", "doc_first", [
        ("C", rf"{_PROMPT}\s*(\+?=|\+)\s*[^;\n]{{0,80}}\+\s*{_USER}"),
        ("C", rf"{_PROMPT}\s*=\s*f['\"][^'\"\n]*\{{[^}}\n]*{_USER}"),
        ("C", r"system_?prompt\s*\+\s*\w*(user|input|external|untrusted)"),
        ("C", r"prompt\s*=\s*(request\.|req\.)(json|form|args|body|data|query)"),
        ("C", rf"prompt\w*\.format\s*\([^)\n]*{_USER}"),
        ("C", r"prompt\s*\+?=[^;\n]{0,80}(requests\.get|fetch\(|urlopen)"),
        ("C", r"prompt\s*\+?=[^;\n]{0,80}(scraped|soup\.|page_content|html)"),
        ("C", r"prompt\s*\+?=[^;\n]{0,80}(document|doc)\.(text|content|page_content)"),
    ], control=VALIDATION, softened=True, message="Text of a user becomes part of the instructions; keep the two apart"),
    group("LLM02", "doc_first", [
        r"(api_?key|secret|token|password)\s*=\s*['\"][A-Za-z0-9_\-]{16,}['\"]",
        r"(log(ger|ging)?\.\w+|print|console\.log)\s*\([^)\n]{0,80}prompt",
        r"return\s+[^;\n]{0,60}system_?prompt",
        r"(response|return)\s*[=(:]?[^;\n]{0,60}(config|credentials?|api_?key|secret)",
        r"(except|catch|raise|throw|error)[^;\n]{0,60}prompt",
        r"(response|return)\s*[=(:]?[^;\n]{0,60}\b(ssn|social_security|credit_card|passport)",
        r"(return|expose|dump)\s*[^;\n]{0,40}training_?data",
    ], severity="H", message="Something confidential can be read from code, logs or answers"),
    group("LLM03", "doc_first", [
        r"(torch\.load|joblib\.load|pickle\.load)\s*\(",
        r"from_pretrained\s*\(\s*[^)\n]*(user|input|request|url)",
        r"pickle\.loads?\s*\(",
        r"['\"]http://[^'\"\s]+\.(bin|pt|pth|onnx|safetensors|pkl|h5)",
        r"trust_remote_code\s*=\s*True",
    ], severity="H", message="A model, package or data file is taken on trust; pin it and check its origin"),
    group("LLM04", "doc_first", [
        r"(\.fit|\.train|fine_?tune)\s*\([^)\n]*(user|request|upload)",
        r"embed\w*\s*\([^)\n]*(user|request|external|untrusted)",
        r"(train|fine_?tune)\w*[^;\n]{0,60}feedback",
        r"(rlhf|reward)\w*[^;\n]{0,60}(user|request)",
    ], severity="H", message="Content that anybody can write shapes what the model learns or retrieves"),
    group("LLM05", "doc_first", [
        rf"(innerHTML|dangerouslySetInnerHTML|v-html|Markup\()\s*[=:(]?[^;\n]{{0,60}}{_REPLY}",
        rf"\beval\s*\([^)\n]*{_REPLY}",
        rf"\bexec\s*\([^)\n]*{_REPLY}",
        rf"(subprocess\.\w+|os\.system|os\.popen)\s*\([^)\n]*{_REPLY}",
        rf"document\.write\s*\([^)\n]*{_REPLY}",
        rf"(execute|query)\s*\([^)\n]*{_REPLY}",
        rf"(execSync|spawn|child_process\.\w+)\s*\([^)\n]*{_REPLY}",
        rf"new\s+Function\s*\([^)\n]*{_REPLY}",
    ], severity="C", message="An answer of the model is acted on as if it were trusted code or markup"),
    group("LLM06", "doc_first", [
        rf"auto_?(execute|run){_ON}",
        r"(delete|drop|remove|destroy)\w*[^;\n]{0,60}(confirm\w*\s*=\s*False|without_confirm)",
        rf"(admin|root|sudo|elevated)(_mode|_privileges)?{_ON}",
        r"permissions?\s*[:=]\s*\[?\s*['\"]\*['\"]",
        rf"(human_?(review|approval|oversight|in_?the_?loop)){_OFF}",
        rf"auto_?approve{_ON}",
        rf"(allow_?shell|shell_?access|enable_?shell){_ON}",
        r"(ShellTool|BashTool|TerminalTool|PythonREPLTool)\b",
        r"service_?account\s*[:=]",
        rf"privileged{_ON}",
    ], severity="H", control=HUMAN, softened=True, message="The agent may do more, or do it more quietly, than its task needs"),
    group("LLM07", "doc_first", [
        r"system_?prompt\s*=\s*['\"]{1,3}[^'\"]{500,}",
        r"system_?prompt\s*=\s*[^;]{0,300}(password|api_?key|secret|token)",
        r"(output|response|return)[^;\n]{0,40}system_?prompt",
        r"system_?prompt\s*=\s*[^;]{0,300}(database|table|schema|connection)",
        r"system_?prompt\s*=\s*[^;]{0,300}(internal|confidential|do not (share|reveal))",
        r"system_?prompt\s*=\s*[^;]{0,300}(admin|root|superuser)",
        r"system_?prompt\s*=\s*[^;]{0,300}(limit|threshold|restriction)",
    ], severity="H", message="Steering text holds, or gives away, what should stay private"),
    group("LLM08", "doc_first", [
        rf"embed\w*\s*\([^)\n]*{_USER}",
        rf"similarity_search\s*\([^)\n]*{_USER}",
        r"(pinecone|weaviate|qdrant|chroma|milvus)[^;\n]{0,60}(public|0\.0\.0\.0|anonymous)",
        r"embed\w*\s*\([^)\n]*(email|ssn|phone|address|personal)",
        r"\.(query|search)\s*\([^)\n]*filter\s*=\s*None",
        r"(shared|global)_?(embeddings?|index|collection)",
    ], severity="M", message="Stored vectors can be filled or searched without a check"),
    group("LLM09", "doc_first", [
        r"(medical|legal|financial)_?advice",
        rf"(fact_?check\w*|grounding){_OFF}",
        rf"allow_?hallucinat\w*{_ON}",
        rf"(verify|verification)_?(response|output)?{_OFF}",
    ], severity="M", message="Answers are passed on as fact with nothing that checks them"),
    group("LLM10", "doc_first", [
        r"max_tokens\s*[:=]\s*(None|null|-1)",
        r"max_tokens\s*[:=]\s*([1-9][0-9]{5,})",
        r"while\s+True\s*:[^\n]*\n(\s+[^\n]*\n){0,5}?\s+[^\n]*(generate|complete|invoke|chat)\s*\(",
        r"(prompt|input)\w*\s*\*\s*[0-9]{2,}",
        r"timeout\s*[:=]\s*(None|null|0\b)",
        r"(max_)?retries\s*[:=]\s*(None|null|-1|float\(['\"]inf)",
        r"(budget|cost)(_limit)?\s*[:=]\s*(None|null|-1)",
    ], severity="H", control=RATE_LIMIT, softened=True, message="Use of the model has no ceiling on cost, length or repetition"),
), gate_words=("openai", "anthropic", "langchain", "llama", "llm", "gpt", "claude", "chatgpt", "gemini", "huggingface", "transformers", "completion", "prompt", "embedding", "chat_model", "cohere", "mistral", "bedrock", "vertexai"), extensions=CODE)

MODEL_ATTACK = Family("model_attack", (
    group("MA001", "doc_first", [
        r"(num_)?epochs?\s*[:=]\s*[1-9][0-9]{2,}",
        rf"early_stopping{_OFF}",
        r"(weight_decay|l2|regulari[sz]ation)\s*[:=]\s*(0(\.0+)?\b|None)",
        r"dropout\s*[:=]\s*(0(\.0+)?\b|None)",
        r"validation_split\s*[:=]\s*(0(\.0+)?\b|None)",
    ], severity="M", message="Training settings invite the model to memorise its examples"),
    group("MA002", "doc_first", [
        r"model\.(predict|forward)\s*\([^)\n]*(request|req)\.",
        r"predict\w*\s*\([^)\n]*request",
        r"(infer|predict|classify)\w*\s*\([^)\n]*(raw|user)_?input",
    ], severity="H", control=(r"adversarial", r"input_?validation", r"robust\w*", r"rate_?limit", r"authenticat\w+", r"saniti[sz]\w+"), softened=True, message="A prediction runs on a request as received, open to crafted inputs"),
    group("MA004", "doc_first", [
        r"return\s+[^;\n]{0,60}(softmax|logits)",
        r"return\s+[^;\n]{0,60}(predict_proba|probabilities)",
        r"return\s+[^;\n]{0,60}confidence",
        r"(logits|outputs?)\s*/\s*temperature",
        r"return\s+[^;\n]{0,60}top_?k",
    ], severity="M", message="Detailed scores are given out, which helps to copy or invert the model"),
    group("MA005", "doc_first", [
        r"(trigger|backdoor)_?(pattern|phrase|token|word)\s*=",
        r"watermark_?(pattern|trigger)\s*=",
        r"if\s+[^:\n]{0,60}(trigger|pattern)[^:\n]{0,40}:\s*(\n\s*)?return\s+['\"0-9]",
        r"(load_dataset|read_csv)\s*\(\s*['\"]http://",
        r"load_(weights|state_dict)\w*\s*\([^)\n]*https?://",
    ], severity="H", message="An input pattern seems to switch the model's behaviour"),
    group("MA007", "doc_first", [
        rf"(differential_privacy|dp_enabled|use_dp){_OFF}",
        r"noise(_multiplier|_scale)?\s*[:=]\s*(0(\.0+)?\b|None)",
        r"(max_grad_norm|clip_grad\w*|gradient_clip\w*)\s*[:=]\s*(0(\.0+)?\b|None|False)",
    ], severity="M", message="Training has no noise or clipping that would protect single records"),
    group("MA010", "doc_first", [
        r"@(app|router)\.(post|get|route)\s*\([^)\n]*(predict|infer|model)",
        r"(public|open)_?(endpoint|api)[^;\n]{0,40}model",
        r"app\.(post|get)\s*\(\s*['\"]/\w*(predict|infer|generate)",
    ], severity="H", control=(r"adversarial", r"input_?validation", r"robust\w*", r"rate_?limit", r"authenticat\w+", r"saniti[sz]\w+"), message="Predictions can be asked for over the network; check who may, and how often"),
), gate_words=("model", "train", "predict", "inference", "neural", "tensorflow", "torch", "keras", "sklearn", "classifier", "machine learning", "deep learning", "dataset", "epoch", "gradient", "weights"), extensions=CODE[:5])

LLMOPS = Family("llmops", (
    group("LO001", "doc_first", [
        r"(pickle|torch|joblib)\.load\s*\([^)\n]*(https?://|urlopen|requests)",
        r"load_(weights|model|state_dict)\s*\([^)\n]*(user|request|input)",
        r"from_pretrained\s*\([^)\n]*(user|request|input|args)",
        r"(pickle|dill|cloudpickle|marshal)\.loads?\s*\(",
        r"\b(eval|exec)\s*\([^)\n]*model",
    ], severity="C", message="A model file that can run code is loaded from a place others can write to"),
    group("LO002", "absent", severity="L", message="Saved models carry no version, so a release can't be traced", present_all=(r"model", r"save"), control=(r"model_?version", r"version(ing)?\s*[:=]", r"mlflow", r"\bdvc\b", r"wandb", r"register_model", r"model_registry")),
    group("LO003", "absent", severity="M", message="A release has nothing that watches it in use", present=(r"deploy",), control=(r"monitor", r"prometheus", r"grafana", r"metrics?", r"telemetry", r"datadog", r"observab", r"alert", r"logging")),
    group("LO004", "doc_first", [
        r"fine_?tun\w*\s*\([^)\n]*(untrusted|external|user|request)",
        r"(trainer|model)\.(train|fit)\s*\([^)\n]*(user|upload|request)",
        r"(adapter|lora)\w*[^;\n]{0,60}(public|/tmp)",
        r"(lora|adapter)\w*[^;\n]{0,60}https?://",
    ], severity="H", message="Tuning uses, or leaves behind, data and weights nobody has vetted"),
    group("LO005", "absent", severity="L", message="Nothing would notice when live data moves away from the training data", present=(r"deploy",), control=(r"drift", r"data_?quality", r"distribution_?shift", r"evidently", r"\bpsi\b", r"ks_test", r"baseline")),
    group("LO006", "doc_first", [
        r"feedback\s*=\s*(request|req)\.",
        r"(rlhf|rlaif)\w*[^;\n]{0,60}(user|request)",
        r"train\w*\s*\([^)\n]*feedback",
        r"fine_?tun\w*[^;\n]{0,60}rating",
    ], severity="H", message="Ratings from users flow into training unseen"),
    group("LO007", "doc_first", [
        r"checkpoint\w*[^;\n]{0,60}(public|/tmp|/var/www)",
        r"checkpoint\w*[^;\n]{0,60}s3://[^;\n]{0,60}public",
        r"(save|save_pretrained|torch\.save)\s*\([^)\n]*(/tmp|/var/www|public)",
    ], severity="H", message="Intermediate weights are kept where others can read or swap them"),
    group("LO009", "doc_first", [
        r"['\"]http://[^'\"\s]*(model|weights|checkpoint)",
        r"ftp://[^'\"\s]*",
        r"download\w*\s*\([^)\n]*(verify\s*=\s*False|checksum\s*=\s*None)",
    ], severity="H", message="Weights travel over a channel that is neither private nor checked"),
    group("LO010", "absent", severity="M", message="Training and releases leave no record of who did what", present=(r"train", r"deploy"), control=(r"audit", r"lineage", r"experiment_?track\w*", r"log_(param|metric|artifact)s?")),
), gate_words=("model", "train", "deploy", "mlflow", "pipeline", "checkpoint", "fine_tune", "finetune", "weights", "inference", "huggingface", "torch", "tensorflow", "kubeflow"), extensions=(".py", ".yaml", ".yml", ".json", ".toml"))

VECTOR_DB = Family("vector_db", (
    group("VD001", "absent", severity="H", message="The index is stored and reached in the clear", control=(r"encrypt", r"\btls\b", r"\bssl\b", r"https://", r"\bkms\b")),
    group("VD002", "absent", severity="H", message="Anyone who reaches the index can read and write it", control=(r"api_?key", r"authenticat\w+", r"authoriz\w+", r"\brbac\b", r"access_?control", r"permission", r"\btoken\b")),
    group("VD003", "doc_first", [
        r"embed\w*\s*\([^)\n]*(ssn|email|phone|address|credit_card)",
        r"embedding\w*[^;\n]{0,60}(personal|pii)",
        r"(upsert|insert|add)\s*\([^)\n]*(ssn|email|phone|personal)",
        r"embed\w*\s*\([^)\n]*user_?(data|profile|info)",
    ], severity="H", message="Details about people are turned into vectors and kept"),
    group("VD004", "doc_first", [
        r"similarity_search\w*\s*\([^)\n]*(user|input|query)",
        r"\.query\s*\([^)\n]*(request|req)\.",
        r"@(app|router)\.\w+\s*\([^)\n]*(search|similar)",
        r"top_?k\s*[:=]\s*[1-9][0-9]{2,}",
    ], severity="M", message="A search takes its query from a request as received"),
    group("VD005", "absent", severity="M", message="Tenants share one index with nothing between them", control=(r"tenant", r"namespace", r"partition", r"isolat\w+", r"collection_name", r"user_id")),
    group("VD006", "doc_first", [
        r"(host|bind|listen)\w*\s*[:=]\s*['\"]?0\.0\.0\.0",
        r"ports?\s*[:=]\s*\[?\s*['\"]?(6333|19530|8080|8000|6334):",
        r"(allow_all|cors|allowed_origins|allow_origins)\s*[:=]\s*\[?['\"]?(true|\*)",
    ], severity="C", message="The index listens where the public can reach it"),
    group("VD007", "absent", severity="L", message="Vectors can't be traced to the document they came from", control=(r"provenance", r"source", r"metadata", r"lineage", r"origin")),
    group("VD008", "doc_first", [
        r"embed\w*\s*\([^)\n]*(untrusted|external|scraped)",
        r"embeddings?\.create\s*\([^)\n]*(user|input\s*=\s*request)",
        r"embed\w*\s*\([^)\n]*(request|req|response)\.",
    ], severity="M", message="Outside text is turned into vectors without a look at it"),
    group("VD009", "absent", severity="L", message="Reads and writes of the index leave no record", control=(r"audit", r"\blogg(er|ing)\b", r"\blog\.", r"trace")),
), gate=(r"pinecone", r"weaviate", r"milvus", r"qdrant", r"chroma(db)?", r"faiss", r"pgvector", r"vector_?store", r"vector_?db", r"vectordb", r"lancedb", r"opensearch.{0,40}knn", r"redis.{0,40}vector", r"annoyindex"), extensions=(".py", ".js", ".ts", ".yaml", ".yml", ".json", ".toml", ".env"))


