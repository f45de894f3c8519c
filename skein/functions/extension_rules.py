"""Signatures that a deployment may add to the built-in ones, as rows of a rules table."""

from __future__ import annotations

from .rule_index import Rule

# Id, family, severity, pattern.
EXTENSION_RULES: list[Rule] = [
    ("sqli_union_select", "sqli", "high", r"\bUNION\s+(ALL\s+)?SELECT\b"),
    ("sqli_or_tautology", "sqli", "high", r"'\s*OR\s+['\d]+=['\d]+"),
    ("sqli_and_tautology", "sqli", "high", r"'\s*AND\s+['\d]+=['\d]+"),
    ("sqli_sleep", "sqli", "high", r"\bSLEEP\s*\(\s*\d+\s*\)"),
    ("sqli_benchmark", "sqli", "high", r"\bBENCHMARK\s*\(.*,.*\)"),
    ("sqli_waitfor", "sqli", "high", r"\bWAITFOR\s+DELAY\b"),
    ("sqli_pg_sleep", "sqli", "high", r"\bpg_sleep\s*\("),
    ("sqli_extractvalue", "sqli", "high", r"\bEXTRACTVALUE\s*\(.*,.*\)"),
    ("sqli_updatexml", "sqli", "high", r"\bUPDATEXML\s*\(.*,.*\)"),
    ("sqli_drop_table", "sqli", "high", r"\bDROP\s+TABLE\b"),
    ("sqli_into_outfile", "sqli", "high", r"\bINTO\s+(OUTFILE|DUMPFILE)\b"),
    ("sqli_information_schema", "sqli", "medium", r"\bINFORMATION_SCHEMA\b"),
    ("sqli_load_file", "sqli", "high", r"\bLOAD_FILE\s*\("),
    ("sqli_group_concat", "sqli", "medium", r"\bGROUP_CONCAT\s*\("),
    ("sqli_floor_rand", "sqli", "high", r"\bFLOOR\s*\(\s*RAND\s*\("),
    ("xss_script_tag", "xss", "high", r"<\s*script[^>]*>"),
    ("xss_onerror", "xss", "high", r"\bonerror\s*="),
    ("xss_onload", "xss", "high", r"\bonload\s*="),
    ("xss_javascript_uri", "xss", "high", r"javascript\s*:"),
    ("xss_img_tag", "xss", "high", r"<\s*img[^>]+onerror"),
    ("xss_svg_onload", "xss", "high", r"<\s*svg[^>]*onload"),
    ("xss_alert_call", "xss", "medium", r"\balert\s*\(.*\)"),
    ("xss_document_cookie", "xss", "high", r"document\.cookie"),
    ("xss_eval_call", "xss", "medium", r"\beval\s*\(.*\)"),
    ("xss_innerHTML", "xss", "medium", r"\.innerHTML\s*="),
    ("xss_data_uri", "xss", "high", r"data:text/html"),
    ("xss_iframe_srcdoc", "xss", "high", r"<\s*iframe[^>]+srcdoc"),
    ("xss_video_onerror", "xss", "high", r"<\s*video[^>]*onerror"),
    ("cmdi_pipe_cmd", "cmdi", "high", r"\|\s*(cat|ls|id|whoami|uname|dir|type|ipconfig|ifconfig|netstat|ps|wget|curl|nc|bash|sh|python|perl|ruby|php)\b"),
    ("cmdi_semicolon_cmd", "cmdi", "high", r";\s*(cat|ls|id|whoami|wget|curl|nc|bash|sh|python)\b"),
    ("cmdi_backtick", "cmdi", "high", r"`[^`]{1,50}`"),
    ("cmdi_dollar_subshell", "cmdi", "high", r"\$\([^)]+\)"),
    ("cmdi_dev_null", "cmdi", "medium", r">\s*/dev/null"),
    ("cmdi_etc_passwd", "cmdi", "medium", r"/etc/(passwd|shadow|hosts)"),
    ("cmdi_and_chain", "cmdi", "high", r"&&\s*(cat|ls|id|whoami|wget|curl|ping|bash|sh)"),
    ("cmdi_newline_bypass", "cmdi", "high", r"%0[ad]\s*(cat|ls|id|whoami)"),
    ("cmdi_ifs_bypass", "cmdi", "medium", r"\$\{?IFS\}?"),
    ("cmdi_wildcard_cmd", "cmdi", "medium", r"[/\w]*\?[/\w]*\*"),
]
