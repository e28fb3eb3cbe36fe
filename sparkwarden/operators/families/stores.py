"""Rules for memory and retrieval settings (``agent_memory``, ``rag``)."""

from __future__ import annotations

from ..rules import Family, group

_OFF = r"['\"]?\s*[:=]\s*['\"]?(false|no|off|0|none|disabled)\b"
_ON = r"['\"]?\s*[:=]\s*['\"]?(true|yes|on|1|enabled)\b"
_KEY = r"['\"]?\s*[:=]\s*['\"]?"

MEMORY = (
    group("AIM001", "line_first", [
        ("C", rf"(encrypt\w*|encryption_enabled){_OFF}"),
        ("C", r"(unencrypted|plain_?text)['\"]?\s*[:=]\s*['\"]?(true|yes|1)"),
        ("H", rf"(use_)?(tls|ssl)(_enabled)?{_OFF}"),
        ("M", rf"storage(_type|_backend)?{_KEY}(file|local|json|sqlite)\b"),
    ], 311, message="What the agent remembers is stored or sent in the clear"),
    group("AIM002", "line_first", [
        ("C", rf"(access|visibility|scope){_KEY}(public|all|everyone|world|\*)"),
        ("C", rf"(mode|permissions?|chmod){_KEY}0?(777|666)"),
        ("H", rf"(shared|global)_?(memory|access|state){_ON}"),
        ("C", rf"(require_auth|auth\w*_required|authentication){_OFF}"),
    ], 732, message="Others can read or change what the agent remembers"),
    group("AIM003", "line_first", [
        ("H", rf"saniti[sz]e\w*{_OFF}"),
        ("H", rf"validat\w*{_OFF}"),
        ("H", rf"(raw|unsafe)(_mode|_input)?{_ON}"),
        ("M", rf"(content_)?filter\w*{_OFF}"),
    ], 20, message="Anything may be written to memory without a check"),
    group("AIM004", "line_first", [
        ("M", rf"max_?(size|memory|tokens|bytes){_KEY}(null|none|-1|0|unlimited|infinity)\b"),
        ("M", rf"max_?(items|entries|messages|history){_KEY}(null|none|-1|0|unlimited|infinity)\b"),
        ("M", rf"(prun\w*|trim\w*|compact\w*){_OFF}"),
    ], 400, message="Memory may grow without end"),
    group("AIM005", "line_first", [
        ("M", rf"(ttl|expir\w*|retention\w*){_KEY}(null|none|-1|0|never|unlimited|infinite)\b"),
        ("M", rf"(permanent|persist_forever){_ON}"),
        ("M", rf"(clean_?up|garbage_collect\w*|auto_delete){_OFF}"),
    ], 613, message="Memory is kept for good"),
    group("AIM006", "line_first", [
        ("C", rf"(password|passwd|pwd){_KEY}[^'\"\s$<{{]{{6,}}"),
        ("C", rf"api_?key{_KEY}[A-Za-z0-9_\-]{{16,}}"),
        ("C", rf"(secret|token){_KEY}[A-Za-z0-9_\-]{{16,}}"),
        ("C", r"-----BEGIN\s+\w*\s*PRIVATE\s+KEY"),
        ("C", r"\bsk-[A-Za-z0-9]{20,}"),
        ("C", r"\bsk-ant-[A-Za-z0-9_\-]{20,}"),
        ("C", r"\bgh[pousr]_[A-Za-z0-9]{36}"),
        ("C", r"\bAKIA[0-9A-Z]{16}"),
    ], 798, message="Something secret or personal is kept in memory"),
    group("AIM007", "line_first", [
        ("H", rf"checkpoint\w*(_dir|_path)?{_KEY}(/tmp|/var/tmp|%temp%)"),
        ("C", rf"checkpoint\w*{_KEY}(http|ftp)://"),
        ("H", rf"(verify_)?signature\w*{_OFF}"),
        ("H", rf"(integrity|checksum)\w*{_OFF}"),
    ], 922, message="Saved states can be swapped or read by others"),
    group("AIM008", "line_first", [
        ("H", rf"cross_?-?session\w*{_ON}"),
        ("H", rf"(session_)?isolat\w*{_OFF}"),
        ("M", rf"namespace{_KEY}(global|default|shared|\*)"),
    ], 200, message="Memory of one session can be seen in another"),
    group("AIM009", "line_first", [
        ("C", r"ignore\s+(all\s+)?(previous|prior)\s+instructions"),
        ("C", r"<\s*(hidden|secret|system|instruction)\s*>"),
        ("H", r"you\s+are\s+now\s+(a|an|the|in)\b"),
        ("H", "[​‌‍⁠﻿]"),
    ], 94, message="A remembered text gives orders to the model"),
    group("AIM010", "line_first", [
        ("C", rf"(pinecone|weaviate|qdrant|milvus|chroma)\w*_?(api_?key|token){_KEY}[A-Za-z0-9_\-]{{12,}}"),
        ("H", r"(vector|pinecone|weaviate|qdrant|milvus|chroma)\w*['\"]?\s*[:=]\s*['\"]?http://"),
        ("M", rf"overwrite\w*{_ON}"),
    ], 798, message="The store behind the memory is reached in an unsafe way"),
)

RAG_GROUPS = (
    group("AIR001", "line_first", [
        ("M", rf"(source|url|loader)s?{_KEY}https://"),
        ("H", rf"(source|url|loader)s?{_KEY}http://"),
        ("H", rf"(source|url|loader)s?{_KEY}ftp://"),
        ("M", rf"(source|url|path)s?{_KEY}\$\{{?\w+"),
        ("C", rf"(allow_any_source|allowed_sources){_KEY}(true|\*|any|all)"),
        ("C", r"\.onion\b"),
        ("H", r"(ngrok|localtunnel|serveo)\.\w+"),
    ], 829, message="Documents come from outside over a channel that can be tampered with"),
    group("AIR002", "line_first", [
        ("H", rf"saniti[sz]e\w*{_OFF}"),
        ("H", rf"(strip_html|strip_scripts?|remove_scripts?){_OFF}"),
        ("H", rf"validat\w*{_OFF}"),
        ("M", rf"allow_html{_ON}"),
        ("H", rf"(raw|unsafe)(_mode|_html)?{_ON}"),
    ], 20, message="Documents are taken in without cleaning or checking"),
    group("AIR003", "line_first", [
        ("C", rf"(allow_code_execution|execute_code){_ON}"),
        ("C", rf"(eval|exec)(_enabled)?{_ON}"),
        ("H", r"(allowed_)?(extensions|file_types)['\"]?\s*[:=].*\.?(exe|sh|bat|ps1|py|js)\b"),
        ("C", rf"(run_scripts?|script_execution){_ON}"),
        ("H", rf"macros?(_enabled)?{_ON}"),
    ], 94, message="A document in the collection can bring code that runs"),
    group("AIR004", "line_first", [
        ("H", rf"mixed?_?trust\w*{_ON}"),
        ("M", r"(internal|private).{0,40}(external|public).{0,20}sources?"),
        ("M", rf"(include_)?unverified\w*{_ON}"),
    ], 285, message="Trusted and untrusted documents are kept as one"),
    group("AIR005", "line_first", [
        ("M", rf"(source_)?attribution{_OFF}"),
        ("M", rf"(track_sources?|source_tracking|provenance){_OFF}"),
        ("L", rf"(include_sources?|return_source_documents){_OFF}"),
    ], 346, message="An answer can't be traced to the documents behind it"),
    group("AIR006", "line_first", [
        ("H", r"embedding\w*['\"]?\s*[:=]\s*['\"]?http://"),
        ("C", rf"embedding\w*_?(api_?key|token){_KEY}[A-Za-z0-9_\-]{{12,}}"),
        ("C", rf"(verify_ssl|ssl_verify|verify){_OFF}"),
        ("L", r"embedding\w*.{0,40}(localhost|127\.0\.0\.1)"),
    ], 319, message="The service that makes vectors is reached in an unsafe way"),
    group("AIR007", "line_first", [
        ("C", rf"(vector\w*|pinecone|weaviate|qdrant|milvus|chroma)_?(api_?)?key{_KEY}[A-Za-z0-9_\-]{{12,}}"),
        ("C", rf"(vector\w*|pinecone|weaviate|qdrant|milvus|chroma)_?(password|passwd){_KEY}\S{{6,}}"),
        ("C", r"\w+://[^/\s:@'\"]+:[^/\s:@'\"]+@"),
        ("C", rf"(admin|master|root)_?key{_KEY}[A-Za-z0-9_\-]{{8,}}"),
    ], 798, message="The key to the vector store is written into the settings"),
    group("AIR008", "line_first", [
        ("M", rf"chunk_?size{_KEY}(null|none|-1|unlimited|[1-9][0-9]{{4,}})"),
        ("L", rf"(chunk_?)?overlap{_KEY}(0\b|null|none|false)"),
        ("M", rf"(preserve|respect)_(document_)?boundar\w*{_OFF}"),
    ], 400, message="Documents are cut in a way that mixes or loses their meaning"),
    group("AIR009", "line_first", [
        ("H", rf"(retrieval_|result_)?filter(ing|s)?(_enabled)?{_OFF}"),
        ("M", rf"return_all(_results|_documents)?{_ON}"),
        ("M", rf"(min_?score|similarity_threshold|relevance_threshold|score_threshold){_KEY}(0(\.0+)?\b|null|none)"),
        ("M", rf"(top_?k|max_results|max_documents|limit){_KEY}(null|none|-1|unlimited|[1-9][0-9]{{2,}})"),
    ], 285, message="Retrieval returns whatever it finds, however poor the match"),
    group("AIR010", "line_first", [
        ("C", r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions"),
        ("C", r"<\s*(hidden|secret|system|instruction)\s*>"),
        ("H", r"you\s+are\s+now\s+(a|an|the|in)\b"),
        ("H", r"(if|when)\s+(the\s+)?user\s+(asks?|mentions?|says?)\b.{0,80}(respond|reply|say|answer|output)"),
        ("C", r"(send|post|forward|upload)\s+.{0,60}to\s+https?://"),
    ], 94, message="A document gives orders to the model"),
    group("AIR011", "line_first", [
        ("H", rf"(validate_sources?|source_validation){_OFF}"),
        ("H", rf"(check_authority|authority_check){_OFF}"),
        ("M", rf"(check_metadata|metadata_check|metadata_validation){_OFF}"),
        ("H", rf"(resolve_conflicts|conflict_resolution){_OFF}"),
        ("M", rf"(prioriti[sz]e_sources|source_priority|source_prioriti[sz]ation){_OFF}"),
        ("C", rf"(bypass|skip)_validation{_ON}"),
        ("C", rf"trust_all(_sources)?{_ON}"),
        ("L", rf"(knowledge_)?gap_(handling|detection){_OFF}"),
    ], 285, message="Nothing tells whether a source may be believed"),
    group("AIR012", "line_first", [
        ("H", rf"reconcil\w*{_OFF}"),
        ("H", rf"(update_interval|refresh(_interval)?){_KEY}(never|null|none|0|-1)\b"),
        ("H", rf"(verify_sources?|source_verification){_OFF}"),
        ("M", rf"relevance_filter\w*{_OFF}"),
        ("M", rf"relevance(_score)?{_KEY}(0(\.0+)?|null|none)\b"),
        ("H", rf"contradiction\w*{_OFF}"),
        ("M", rf"conflict_strategy{_KEY}(none|null|ignore)"),
        ("M", rf"completeness\w*{_OFF}"),
        ("L", rf"(cross_chunk|link_chunks)\w*{_OFF}"),
        ("L", rf"(embedding_)?cach(e|ing)(_enabled)?{_OFF}"),
        ("L", rf"batch_?size{_KEY}1\b"),
    ], 400, message="The collection ages, drifts or is refilled without anyone looking"),
)

AGENT_MEMORY = Family("agent_memory", MEMORY, extensions=(".json", ".yaml", ".yml", ".toml"))
RAG = Family("rag", RAG_GROUPS, extensions=(".json", ".yaml", ".yml", ".toml"))
