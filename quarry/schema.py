"""Schemas of the stored tables."""

CHUNKS = (
    "id long, source_type string, repo string, language string, symbol string, path string, start_line int, end_line int, text string, "
    "file_sha string, mtime double, embedding array<float>"
)
DEFINITIONS = "file string, symbol_name string, language string, start_line int, end_line int"
IMPORTS = "importing_file string, imported_module string, imported_name string"
CALLS = "file string, caller string, callee string, line_in_caller int"
QUERIES = "ts double, cwd string, query string, scope_types string, scope_repos string, rerank int, top_score double, top_path string, n_results int"
CHUNK_ARRAY = "array<struct<start_line:int,end_line:int,body:string,symbol:string>>"
CASES = "query string, expect array<string>, scope array<string>"
