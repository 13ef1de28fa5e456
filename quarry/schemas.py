"""Explicit schemas of the fact relations; nothing is inferred."""

FIELDS = "array<struct<name:string,type:string,optional:boolean>>"
MODEL_FIELDS = "array<struct<name:string,type:string,required:boolean,is_relation:boolean,attributes:array<string>>>"

FILES = "relative_path string, language string, mtime_ms double, size long"
SYMBOLS = "name string, kind string, signature string, file_path string, line int, is_exported boolean, is_default boolean, language string, seq int"
TYPES = f"name string, kind string, fields {FIELDS}, file_path string, line int, is_exported boolean, language string, seq int"
ROUTES = "method string, path string, file_path string, line int, handler string, auth boolean, framework string, seq int"
MODELS = f"name string, fields {MODEL_FIELDS}, file_path string, orm string, seq int"
IMPORTS = "source string, resolved_path string, file_path string, line int, is_external boolean, language string, seq int"
FINDINGS = "rule string, rule_order int, severity string, file_path string, related_files array<string>, title string, signals array<string>, action string, heat long, score long"
EDGES = "src string, dst string"
MANIFEST = "relative_path string, mtime_ms double, size long"
#: All facts of a file in one row shape, as the extractor gives them.
FACTS = f"kind string, file_path string, language string, seq int, line int, name string, what string, detail string, exported boolean, extra string, fields {FIELDS}, model_fields {MODEL_FIELDS}"
