"""Scalar text functions of the engine as Columns (survey rows K1, K2, K20, K24, E1-E7, M2, M4, M5, D10, J5)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes (all of Unicode's), as characters.
BLANKS = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
CJK = r"[\x{4e00}-\x{9fff}]"

# Path parts that say nothing about a domain, and file names of helpers.
GENERIC_DIRS = ["src", "source", "lib", "app", "apps", "packages", "package", "python", "js", "ts"]
HELPER_NAMES = ["utils", "util", "helpers", "helper", "common", "base", "config", "constants", "types", "models", "test"]
# Patterns of the four kinds of task terms.
TERM_PATTERNS = {
    "core": rf"[a-z_][a-z0-9_.:-]{{2,}}|{CJK}{{2,}}",
    "provider": rf"[a-z_][a-z0-9_.-]{{2,}}|{CJK}{{2,}}",
    "functional": rf"[a-z][a-z0-9_-]{{2,}}|{CJK}{{2,}}",
}
# Ordered clause rules; (type, confidence, pattern, only for assistants).
CLAUSE_RULES = [
    ("constraint", 0.96, r"(?i)不能|不得|不可|禁止|不允许|不能够|must not|should not|without", False),
    ("decision", 0.9, r"(?i)决定|采用|应该|应保持|保持独立|方案是|recommend|should|decision", True),
    ("requirement", 0.9, r"(?i)(?:我要|我们要).*(?:增加|添加).*(?:支持|能力|功能)", False),
    ("task", 0.88, r"(?i)修复|修改|实现|增加|添加|编写|重构|测试|排查|fix|implement|add|refactor|test", False),
    ("requirement", 0.9, r"(?i)必须|需要|应当|要求|支持|使用|改成|改为|替换为|must|need|require|support|use|replace|change to", False),
    ("issue", 0.76, r"(?i)错误|失败|异常|bug|issue|failure|error", False),
]
# Patterns that split text into sentences and clauses and find semantic fields.
SENTENCE = r"[。！？!?]\s*|\n+"
CLAUSE = r"(?:，|,)?(?:并且|而且|同时)|[；;]"
MODAL = r"改成|改为|替换为|必须|需要|应当|使用|采用|should|must|use"
ASSIGNMENT = r"(?i)^(.{1,48}?)(?:必须|应当|需要|采用|使用|改成|改为|替换为|must|should|use|replace(?:d)?(?: with)?|change(?:d)? to)\s*[:：]?\s*(.+)$"
PROHIBITION = r"(?i)^(.{1,48}?)(?:不能|不得|禁止|must not|should not|without)\s*[:：]?\s*(.+)$"


def filled(*cols: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def trim_all(col: Column) -> Column:
    """Trim all Unicode white space."""
    return F.btrim(col, F.lit(BLANKS))


def token_estimate(col: Column) -> Column:
    """K1: a token for each wide code point, a quarter for each other, rounded up."""
    text = F.coalesce(col, F.lit(""))
    wide = F.regexp_count(text, F.lit(r"[^\x{00}-\x{FF}]"))
    return F.ceil((F.length(text) - wide) * F.lit(0.25) + wide).cast("bigint")


def content_hash(col: Column) -> Column:
    """K2: SHA-256 of the text."""
    return F.sha2(F.coalesce(col, F.lit("")), 256)


def task_terms(col: Column, kind: str = "core") -> Column:
    """Terms of a task in order, repeats included; ``document`` adds CJK bigrams and keeps each once."""
    text = F.lower(F.coalesce(col, F.lit("")))
    if kind != "document":
        return F.regexp_extract_all(text, F.lit(TERM_PATTERNS[kind]), F.lit(0))
    words = F.regexp_extract_all(text, F.lit(rf"[a-z][a-z0-9_-]{{1,}}|{CJK}{{2,}}"), F.lit(0))
    pairs = lambda w: F.when(w.rlike(rf"^{CJK}") & (F.length(w) > 2), F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array())
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(F.array(w), pairs(w)))))


def clauses(col: Column) -> Column:
    """Trimmed, non-empty clauses in order."""
    sentences = F.split(F.coalesce(col, F.lit("")), SENTENCE, -1)
    parts = F.flatten(F.transform(sentences, lambda s: F.split(s, CLAUSE, -1)))
    return F.filter(F.transform(parts, trim_all), lambda c: c != "")


def clause_type(text: Column, role: Column) -> tuple[Column, Column]:
    """Type and confidence of a clause by the first rule that fits; null if none does."""
    kind = sure = None
    for name, confidence, pattern, assistant in CLAUSE_RULES:
        fits = text.rlike(pattern) & (role == "assistant") if assistant else text.rlike(pattern)
        kind = F.when(fits, F.lit(name)) if kind is None else kind.when(fits, F.lit(name))
        sure = F.when(fits, F.lit(confidence)) if sure is None else sure.when(fits, F.lit(confidence))
    return kind, sure


def topic_key(text: Column) -> Column:
    """Lower-cased text without codecs' numbers, modal words and punctuation."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"h\.?26[45]", "video-codec"), MODAL, "")
    return F.trim(F.regexp_replace(plain, r"[^a-z0-9\x{4e00}-\x{9fff}-]+", " "))


def semantic_fields(text: Column) -> tuple[Column, Column, Column]:
    """Subject, slot and value: a codec, an assignment, a prohibition, else the topic alone."""
    codec = F.regexp_extract(text, r"(?i)h\.?26([45])", 1)
    is_codec, is_set, is_ban = codec != "", text.rlike(ASSIGNMENT), text.rlike(PROHIBITION)
    group = lambda pattern, k: topic_key(F.regexp_extract(text, pattern, k))
    subject = F.when(is_codec, F.lit("video")).when(is_set, group(ASSIGNMENT, 1)).when(is_ban, group(PROHIBITION, 1)).otherwise(topic_key(text))
    slot = F.when(is_codec, F.lit("codec")).when(is_set, F.lit("value")).when(is_ban, F.lit("prohibition")).otherwise(F.lit(""))
    value = F.when(is_codec, F.concat(F.lit("h.26"), codec)).when(is_set, group(ASSIGNMENT, 2)).when(is_ban, group(PROHIBITION, 2)).otherwise(F.lit(""))
    return subject, slot, value


def node_semantic_fields(subject: Column, slot: Column, value: Column, metadata: Column, content: Column) -> tuple[Column, ...]:
    """E5: each field by itself: the node's own, else its metadata's (JSON), else what its content says; an empty one says nothing."""
    tree = F.try_parse_json(metadata)
    said = semantic_fields(F.coalesce(content, F.lit("")))
    given = {"subject": subject, "slot": slot, "value": value}
    return tuple(F.coalesce(F.nullif(own, F.lit("")), F.nullif(F.try_variant_get(tree, f"$.{name}", "string"), F.lit("")), derived) for (name, own), derived in zip(given.items(), said))


def node_tokens(content: Column, description: Column, kind: Column, path: Column, size: Column) -> Column:
    """Tokens of what a node holds, else a quarter of its file's bytes; symbols have no file of their own."""
    inline = filled(content, description, F.lit(""))
    whole = ~(F.startswith(kind, F.lit("implementation_")) & (kind != "implementation_file"))
    return F.when(trim_all(inline) != "", token_estimate(inline)).when((F.coalesce(path, F.lit("")) != "") & F.coalesce(whole, F.lit(True)), F.ceil(F.coalesce(size, F.lit(0)) / 4)).otherwise(0).cast("bigint")


def stable_id(prefix: Column, *parts: Column) -> Column:
    """Prefix and 12 hex digits of the parts joined by NUL."""
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, F.char(F.lit(0)), part)
    return F.concat(prefix, F.lit("-"), F.substring(F.sha2(joined, 256), 1, 12))


def clause_title(text: Column) -> Column:
    """At most 48 characters without outer punctuation."""
    clean = F.regexp_replace(trim_all(text), r"^[：:，,\s]+|[。.!！?？\s]+$", "")
    return F.when(F.length(clean) > 48, F.concat(F.substring(clean, 1, 47), F.lit("…"))).otherwise(clean)


def domain_key(path: Column, node_id: Column) -> Column:
    """M2: the path part that names the capability of a file."""
    parts = F.filter(F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/", -1), lambda x: x != "")
    last = F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(node_id)
    file = F.regexp_replace(last, r"\.[^.]+$", "")
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    dirs = F.filter(above, lambda x, i: ~F.lower(x).isin(GENERIC_DIRS) & ((i == 0) | (x != F.get(above, i - 1))))
    id_parts = F.filter(F.split(node_id, r"\.", -1), lambda x: x != "")
    deep = F.lower(F.try_element_at(dirs, F.lit(-1)))
    only = F.try_element_at(dirs, F.lit(1))
    named = F.when(F.size(id_parts) > 1, F.try_element_at(id_parts, F.lit(-2))).otherwise(file)
    return (
        F.when(F.size(dirs) >= 2, deep)
        .when((F.size(dirs) == 1) & ~F.startswith(node_id, F.concat(only, F.lit("."), only, F.lit("."))), deep)
        .when(F.lower(file).isin(HELPER_NAMES) & (F.size(dirs) > 0), deep)
        .otherwise(F.lower(named))
    )


def slug(text: Column) -> Column:
    """M5: letters and digits joined by dashes."""
    return filled(F.lower(F.regexp_replace(F.regexp_replace(text, r"[^a-zA-Z0-9\x{4e00}-\x{9fff}]+", "-"), "^-|-$", "")), F.lit("capability"))


def title_case(text: Column) -> Column:
    """M5: words with a capital; words of two to five letters all in capitals."""
    words = F.filter(F.split(text, "[._/-]+", -1), lambda w: w != "")
    said = lambda w: F.when(w.rlike("^[A-Za-z]{2,5}$"), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000)))
    return F.array_join(F.transform(words, said), " ")


def is_test_path(path: Column) -> Column:
    """Whether a path is a test's."""
    low = F.lower(F.coalesce(path, F.lit("")))
    return low.rlike(r"(^|/)tests?(/|$)") | low.rlike(r"(^|/)test_[^/]+\.[^.]+$") | low.rlike(r"_test\.[^.]+$")


def term_hits(text: Column, terms: Column) -> Column:
    """How many of the terms (repeats count) the text holds."""
    low = F.lower(text)
    return F.aggregate(terms, F.lit(0), lambda s, t: s + F.contains(low, t).cast("int"))


def rendered_detail(description: Column, provides: Column, consumes: Column, inputs: Column, outputs: Column) -> Column:
    """A functional node's description and its lists, a line each."""
    line = lambda name, a: F.when(F.size(a) > 0, F.concat(F.lit(f"{name}: "), F.array_join(a, ", ")))
    return F.concat_ws("\n", F.nullif(description, F.lit("")), line("Provides", provides), line("Consumes", consumes), line("Input", inputs), line("Output", outputs))


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1) of a text; the whole text without a valid range."""
    ok = start.isNotNull() & end.isNotNull() & (start >= 1) & (end >= start)
    return F.when(ok, F.array_join(F.slice(F.split(text, r"\r?\n", -1), start, end - start + 1), "\n")).otherwise(text)


# What marks a line as code, and what it may begin with.
CODE_MARKERS = ["def ", "class ", "function ", "const ", "let ", "var ", "import ", "from ", "curl ", "http ", "#include", "=>", "{", "}", ";", "//", "<?", "select ", "post ", "get "]
CODE_STARTS = ["$ ", "> ", "... "]


def code_like(line: Column) -> Column:
    """Whether a line looks like code."""
    bare = F.lower(trim_all(line))
    marked = bare.rlike("|".join(re.escape(m) for m in CODE_MARKERS))
    begun = bare.rlike("^(?:" + "|".join(re.escape(m) for m in CODE_STARTS) + ")")
    return (bare != "") & (line.rlike(r"^\s") | begun | marked)


def code_language(text: Column) -> Column:
    """A guess at the language by ordered signs."""
    low, bare = F.lower(text), F.ltrim(F.lower(text))
    has = lambda *signs: F.greatest(*[F.contains(low, F.lit(x)) for x in signs], F.lit(False))
    # The signs of each language, in order.
    return (
        F.when(has("#include", "std::"), "cpp")
        .when(has("def ") | (has("import ") & has(":")), "python")
        .when(has("const ", "let ", "=>"), "javascript")
        .when(has("curl ") | bare.rlike("^(get|post|put|delete) "), "http")
        .when(has("select ") & has(" from "), "sql")
        .when(bare.rlike(r"^[\{\[]"), "json")
        .otherwise("text")
    )


def table_markdown(rows: Column) -> Column:
    """A table (array of rows of cells) as Markdown: cells cleaned, blank rows left out, short rows filled; null if empty."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: trim_all(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))))
    kept = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(kept, lambda r: F.size(r)))
    full = F.transform(kept, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    said = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    lines = F.transform(full, said)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.when(F.size(kept) > 0, F.array_join(F.concat(F.array(F.element_at(lines, 1), rule), body), "\n"))
