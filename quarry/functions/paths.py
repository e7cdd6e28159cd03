"""Classification of paths and queries as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code extensions, languages by extension, excluded folders (those that begin with .venv or .wt- go by a rule), patterns.
CODE_EXTENSIONS = (".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".sh", ".bash", ".zsh")
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".sh": "shell", ".bash": "shell",
    ".zsh": "shell", ".md": "markdown", ".yml": "yaml", ".yaml": "yaml", ".json": "json", ".toml": "toml", ".rules": "text",
}
EXCLUDED_PARTS = (
    "site-packages htmlcov .eggs .tox node_modules vendor dist build coverage .git .next .turbo venv .venv __pycache__ .pytest_cache .mypy_cache test-results playwright-report "
    ".storybook .docusaurus .worktrees worktrees"
).split()
MAX_FILE_BYTES = 200_000
SYMBOL_LOOKUP = (
    "(?i)\\b(where(\\s+is|'s|\\s+are)|locate|definition of|defined|declared|implementation of|which file|what file|find (the )?(class|function|method|interface|type|symbol|def))\\b"
)
COMMAND_START = "(?i)^(please\\s+|let'?s\\s+)?(rerun|re-run|redo|redeploy|rollback|revert|rebase|cherry-pick|dispatch\\w*)\\b"
COMMAND_STEP = "(?i),\\s*(then\\s+)?(run|rerun|re-run|merge|commit|push|pull|deploy|redeploy|revert|rebase|dispatch\\w*|redo|ship|rollback|start|stop)\\b"
COMMAND_PHRASE = "(?i)\\b(do (these|this|that) for me|for me using|for me,)\\b"
QUESTION_STARTS = ("who ", "what ", "where ", "when ", "why ", "how ", "which ")
SUPERSEDED = "(?m)^valid_to:\\s*\\S"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), "^.+(\\.[^.]+)$", 1))


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("text"))


def is_excluded(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.isin(EXCLUDED_PARTS) | p.startswith(".venv") | p.startswith(".wt-"))


def is_quarantined(path: Column) -> Column:
    return path.contains("/quarantine/")


def is_superseded(source_type: Column, text: Column, same_line: bool = False) -> Column:
    """Memory notes with a valid_to. An empty one counts too if text follows on a later line, unless same_line."""
    return (source_type == "memory") & text.rlike("(?m)^valid_to:[ \\t]*\\S" if same_line else SUPERSEDED)


def is_card(source_type: Column, path: Column, types: tuple[str, ...] = ("handoffs",), patterns: tuple[str, ...] = ()) -> Column:
    named = F.lower(F.element_at(F.split(path, "/"), -1))
    out = source_type.isin(list(types))
    for p in patterns:
        out = out | named.contains(p)
    return out


def source_type(path: Column, code_globs: tuple[str, ...] = ()) -> Column:
    """The first rule that fits names the type."""
    has, ends = path.contains, path.endswith
    in_globs = F.lit(False)
    for g in code_globs:
        in_globs = in_globs | path.startswith(g.split("*", 1)[0])
    rules = [
        (has("/memory/"), "memory"),
        (has("/plans/"), "plans"),
        (has("/adrs/") & ends(".md"), "adrs"),
        (has("/handoffs/"), "handoffs"),
        ((has("/.claude/skills/") | has("/.agents/skills/")) & ends("/SKILL.md"), "skills"),
        (has("/.codex/"), "codex"),
        (has("/standards/") & ends(".md"), "standards"),
        (ends("CHANGELOG.md"), "changelog"),
        (ends("README.md"), "repo-readme"),
        (ends("docs/roadmap.md"), "roadmap"),
        (has("/graphify-out/"), "graph"),
        (has("/docs/specs/") & ends(".md"), "spec"),
        (has("/docs/") & ends(".md"), "repo-docs"),
        (in_globs, "workstation-code"),
        (extension(path).isin(list(CODE_EXTENSIONS)), "code"),
    ]
    out = F.when(*rules[0])
    for condition, name in rules[1:]:
        out = out.when(condition, name)
    return out.otherwise("other")


def repo_of(path: Column, repos: tuple[str, ...]) -> Column:
    """Name of the first repo that is the path or above it."""
    out = F.lit(None).cast("string")
    for r in reversed(repos):
        r = r.rstrip("/")
        out = F.when((path == r) | path.startswith(r + "/"), r.rsplit("/", 1)[-1]).otherwise(out)
    return out


def is_test_path(path: Column) -> Column:
    out = F.lit(False)
    for like in ("%.test.ts", "%.spec.ts", "%_test.py", "%.spec.tsx"):
        out = out | path.ilike(like)
    return out


def is_symbol_lookup(query: Column) -> Column:
    return query.rlike(SYMBOL_LOOKUP)


def is_command(query: Column) -> Column:
    """A mined step of a session, not a question: only clear cases."""
    q = F.trim(F.coalesce(query, F.lit("")))
    low = F.lower(q)
    asks = q.contains("?") | low.startswith("find the ") | low.startswith("definition of ")
    for s in QUESTION_STARTS:
        asks = asks | low.startswith(s)
    return F.when((q == "") | asks, False).when(low.startswith("then "), True).otherwise(q.rlike(COMMAND_START) | q.rlike(COMMAND_PHRASE) | q.rlike(COMMAND_STEP))


def prompt_fits(prompt: Column) -> Column:
    """Prompts that automatic recall answers: neither tiny nor huge, and no notification of a task."""
    return F.length(prompt).between(15, 2000) & ~F.ltrim(prompt).startswith("<task-notification")


def scope_key(scope: Column) -> Column:
    """Names of an array of scopes joined by +, or none."""
    return F.when(scope.isNull() | (F.size(scope) == 0), "none").otherwise(F.array_join(scope, "+"))


def inferred_repo(expected: Column, repos: list[str]) -> Column:
    """The first expected path that names a repo, longest repo names first."""
    ordered = F.array(*[F.lit(r) for r in sorted(repos, key=lambda r: (-len(r), r))])
    named = lambda p: F.filter(ordered, lambda r: p.contains(F.concat(F.lit("/"), r, F.lit("/"))) | p.startswith(F.concat(r, F.lit("/"))))
    return F.get(F.flatten(F.transform(expected, named)), F.lit(0))


def memory_target(scope: Column, expected: Column) -> Column:
    return F.coalesce(scope.contains("memory"), F.lit(False)) | F.exists(expected, lambda e: e.contains("/memory/") | e.startswith("memory/") | e.endswith("MEMORY.md"))


def relevant(expected: Column, paths: Column) -> Column:
    return F.exists(expected, lambda e: F.exists(paths, lambda p: p.contains(e)))
