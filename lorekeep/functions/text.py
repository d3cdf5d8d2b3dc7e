"""Text functions as column expressions; the hot ones stay inside whole-stage code generation."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep import schema as S

WORDS = r"[\p{L}\p{N}]+"
SPACE = r"(?U)\s+"
LINES = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, f) -> Column:
    """f of the value, which is made once: the planner would repeat a plain expression wherever it is named."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c) -> Column:
    """Unicode-wide trim."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def blank(c) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def raw_words(c) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(WORDS), F.lit(0))


def stem(c) -> Column:
    """Suffix stripping in a fixed order: sses, ies, ss, s, then ing or ed with a doubled consonant."""
    w = col(c)
    n = F.length(w)
    cut = lambda x, k: F.substring(x, F.lit(1), F.length(x) - k)
    plural = w.endswith("s") & (n > 3) & ~F.substring(w, -2, 1).isin("s", "u")
    w1 = F.when(plural, cut(w, 1)).otherwise(w)
    base = F.when(w1.endswith("ing") & (F.length(w1) >= 6), cut(w1, 3)).when(w1.endswith("ed") & (F.length(w1) >= 5) & ~w1.endswith("ing"), cut(w1, 2))
    last = F.substring(base, -1, 1)
    doubled = (last == F.substring(base, -2, 1)) & (F.length(base) >= 3) & ~last.isin("l", "s", "z") & (F.substring(base, -2, 2) == F.concat(last, last))
    ended = F.when(base.isNull() | (F.length(base) < 3), w1).when(doubled, cut(base, 1)).otherwise(base)
    return F.when(n <= 2, w).when(w.endswith("sses"), cut(w, 2)).when(w.endswith("ies"), F.when(n > 4, F.concat(cut(w, 3), F.lit("i"))).otherwise(cut(w, 1))).when(w.endswith("ss"), w).otherwise(ended)


def words(c) -> Column:
    """Ordered words in lower case, without stop words: one pass over the text."""
    return F.filter(raw_words(c), lambda w: ~w.isin(S.STOPWORDS))


def tokens(c) -> Column:
    """Ordered stems without stop words."""
    return F.transform(words(c), stem)


def field_tokens(fields: list[tuple[str, int]] | None = None) -> Column:
    """The weighted stream: each field's stems repeated by its weight, in field order."""
    parts = [F.flatten(F.array_repeat(tokens(F.array_join("tags", " ") if name == "tags" else name), weight)) for name, weight in fields or S.FIELD_WEIGHTS]
    return F.concat(*parts)


def contains_phrase(stream, phrase: list[str]) -> Column:
    """Whether phrase is a contiguous run of the stream."""
    if not phrase:
        return F.lit(False)
    want, n = F.array(*[F.lit(p) for p in phrase]), len(phrase)
    starts = F.sequence(F.lit(1), F.size(stream) - n + 1)
    return F.when(F.size(stream) < n, F.lit(False)).otherwise(F.exists(starts, lambda i: F.slice(stream, i, n) == want))


def slugify(c) -> Column:
    """ASCII slug; everything that isn't a-z or 0-9 separates, composed or not, but a letter with a combining mark goes whole, as its composed form does."""
    plain = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[a-z0-9]\p{Mn}+", "-")
    s = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("untitled")).otherwise(s)


def slug_id(c) -> Column:
    """Slugs of the path's segments (either slash parts them), each cut so that its file name fits in 255 bytes."""
    return F.array_join(F.transform(F.split(F.replace(col(c), F.lit("\\"), F.lit("/")), "/"), lambda p: F.substring(slugify(p), 1, S.STEM_MAX)), "/")


def suffixed_id(base, n) -> Column:
    """base-n, the last segment cut so that its file name still fits."""
    end = F.concat(F.lit("-"), col(n).cast("string"))
    last = F.regexp_extract(col(base), "[^/]*$", 0)
    cut = F.substring(last, F.lit(1), S.STEM_MAX - F.length(end))
    return F.concat(F.substring(col(base), F.lit(1), F.length(col(base)) - F.length(last)), F.when(cut == "", "untitled").otherwise(cut), end)


def normalize_title(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", " "))


def collapse(c) -> Column:
    return strip(F.regexp_replace(col(c), SPACE, " "))


def source_digest(source, title, text) -> Column:
    return F.sha2(collapse(F.lower(F.concat_ws("\n", col(source), col(title), col(text)))), 256)


def title_similarity(a, b) -> Column:
    def of(pair):
        both = F.size(F.array_intersect(pair["x"], pair["y"]))
        return F.when((F.size(pair["x"]) == 0) | (F.size(pair["y"]) == 0), F.lit(0.0)).otherwise(both / (F.size(pair["x"]) + F.size(pair["y"]) - both))

    return let(F.struct(F.array_distinct(tokens(a)).alias("x"), F.array_distinct(tokens(b)).alias("y")), of)


def cosine(a, b) -> Column:
    """Clamped to [-1, 1]; 0 for a zero vector. Vectors of unequal length give an error."""
    x, y = col(a), col(b)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    value = F.when(norm == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(x, y) / norm)))
    return F.when(F.size(x) == F.size(y), value).otherwise(F.raise_error(F.lit("vectors of different dimensions")).cast("double"))


def embed_text(title, body) -> Column:
    return F.substring(strip(F.concat_ws("\n", strip(title), strip(body))), 1, S.EMBED_CHARS)


def describe(c) -> Column:
    """First sentence of 20 characters or more, else all of it, cut at a word within 200."""
    flat = collapse(F.coalesce(col(c), F.lit("")))
    flat = F.regexp_replace(flat, r"\[([^\]]*)\]\([^)]*\)", "$1")
    flat = F.regexp_replace(flat, r"`|\*\*|__", "")
    flat = strip(F.regexp_replace(flat, r"^[#>*\-+ ]+", ""))

    def shorten(best):
        head = F.substring(best, 1, S.DESCRIPTION_MAX)
        cut = F.regexp_replace(F.regexp_replace(head, r" [^ ]*$", ""), r"[,;:]+$", "")
        longer = let(cut, lambda c: F.concat(F.when(c == "", strip(head)).otherwise(c), F.lit("…")))
        return F.when(F.length(best) <= S.DESCRIPTION_MAX, best).otherwise(longer)

    def of(text):
        first = strip(F.regexp_extract(text, r"[^.!?]+[.!?]+", 0))
        best = let(first, lambda x: F.when(F.length(x) < S.SENTENCE_MIN, text).otherwise(x))
        return F.when(text == "", F.lit(S.NO_TEXT)).otherwise(let(best, shorten))

    return let(flat, of)


def truncate(c, limit: int = S.BODY_MAX) -> Column:
    """Cut at the last line end before the limit, with a marker."""
    head = F.substring(col(c), 1, limit)
    cut = F.regexp_replace(head, r"\n[^\n]*\z", "")
    cut = F.when(cut == "", head).otherwise(cut)
    text = F.coalesce(col(c), F.lit(""))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, r"(?U)\s+$", ""), F.lit(S.TRUNCATED)))


def situating_prefix(doc_title, section_path) -> Column:
    return F.concat(F.lit("["), F.concat_ws(" > ", col(doc_title), col(section_path)), F.lit("]"))


def sanitize(c) -> Column:
    """Without script blocks, event attributes and javascript: targets."""
    out = F.regexp_replace(col(c), r"(?is)<script\b.*?</script\s*>", "")
    out = F.regexp_replace(out, r"(?is)</?script\b[^>]*>", "")
    out = F.regexp_replace(out, r"(?is)\son[a-z]+\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    return F.regexp_replace(out, r"(?i)javascript\s*:", "")


def link_targets(c) -> Column:
    """Raw targets of inline links, in order, each once; titles and angle brackets stripped."""
    raw = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(S.LINK), F.lit(2))
    bare = F.transform(raw, lambda t: strip(F.regexp_replace(t, r"""\s+("[^"]*"|'[^']*')\s*$""", "")))
    bare = F.transform(bare, lambda t: F.when(t.rlike(r"^<.*>$"), strip(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t))
    return F.array_distinct(F.filter(bare, lambda t: t != ""))


def without_fragment(c) -> Column:
    return strip(F.regexp_replace(col(c), r"(?s)[#?].*$", ""))


def is_external(c) -> Column:
    return col(c).rlike(S.EXTERNAL) | col(c).startswith("//")


def resolve_path(base_dir, target, clamp: bool = True) -> Column:
    """Target against a directory inside the bundle. `..` above the root clamps, or gives null."""
    path = F.when(col(target).startswith("/"), col(target)).otherwise(F.concat_ws("/", F.when(col(base_dir) != "", col(base_dir)), col(target)))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    state = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))

    def step(s, p):
        up = p == ".."
        at = F.when(up & (F.size(s["at"]) > 0), F.slice(s["at"], 1, F.greatest(F.size(s["at"]) - 1, F.lit(0)))).when(up, s["at"]).otherwise(F.concat(s["at"], F.array(p)))
        return F.struct(at.alias("at"), (s["out"] | (up & (F.size(s["at"]) == 0))).alias("out"))

    done = F.aggregate(parts, state, step)
    joined = F.array_join(done["at"], "/")
    return joined if clamp else F.when(~done["out"], joined)


def parent_dir(c) -> Column:
    return F.when(col(c).contains("/"), F.regexp_replace(col(c), "/[^/]*$", "")).otherwise(F.lit(""))


def leaf(c) -> Column:
    return F.regexp_replace(col(c), "^.*/", "")


def id_target(concept_id, raw) -> Column:
    """The concept id a raw link target names, null for external ones; `.md` dropped, never above the root."""
    t = F.regexp_replace(strip(raw), "^<+|>+$", "")
    cleaned = without_fragment(t)
    out = F.regexp_replace(resolve_path(parent_dir(concept_id), cleaned), r"(?i)\.md$", "")
    bad = (t == "") | t.startswith("#") | t.rlike(S.EXTERNAL) | (cleaned == "")
    return F.when(~bad, F.nullif(out, F.lit("")))


def strip_code(c) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), r"(?s)```.*?```|~~~.*?~~~", ""), r"`[^`\n]*`", "")


def footnote_refs(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"\[\^([^\]\s]+)\](?!:)"), F.lit(1)))


def footnote_definitions(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"(?m)^\[\^([^\]\s]+)\]:"), F.lit(1)))


def split_lines(c) -> Column:
    """Lines without a trailing empty one."""
    lines = F.split(col(c), LINES)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def snippet(c, width: int = 200) -> Column:
    """First line that is neither blank nor a heading, cut."""
    lines = F.filter(F.transform(split_lines(c), strip), lambda x: (x != "") & ~x.startswith("#"))
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, width), F.lit(""))


def search_snippet(c, terms: list[str], width: int = 160) -> Column:
    """A window around the first hit of any term, a third of it before."""
    flat = collapse(c)
    hits = F.filter(F.array(*[F.locate(t, F.lower(flat)) for t in terms]), lambda p: p > 0)
    at = F.coalesce(F.array_min(hits), F.lit(1))
    return F.substring(flat, F.greatest(F.lit(1), at - width // 3), F.lit(width))


def sentences(c) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"(?<=[.!?])\s+"), strip), lambda x: x != "")


def chunks(c, lines: int = S.CHUNK_LINES) -> Column:
    """Pieces of so many lines."""
    all_ = F.split(col(c), "\n")
    return F.transform(F.sequence(F.lit(0), F.size(all_) - 1, F.lit(lines)), lambda i: F.array_join(F.slice(all_, i + 1, lines), "\n"))


def relation_matches(text, target, wanted: str) -> Column:
    w = wanted.lower()
    return F.lower(F.coalesce(col(text), F.lit(""))).contains(w) | F.lower(F.coalesce(col(target), F.lit(""))).contains(w)


def valid_citations(answer, known) -> Column:
    """Brackets are taken off citations whose id is not among the known ones."""
    cited = F.array_distinct(F.regexp_extract_all(col(answer), F.lit(r"\[([^\[\]]+)\]"), F.lit(1)))
    return F.aggregate(F.array_except(cited, col(known)), col(answer), lambda s, i: F.replace(s, F.concat(F.lit("["), i, F.lit("]")), i))


#: Suffixes of each kind of upload.
KINDS = {"pdf": (".pdf",), "markdown": (".md", ".markdown", ".txt"), "wiki": (".zip",)}


def kind_matches(path, kind: str) -> Column:
    """Whether a path has a suffix of this kind; `auto` takes all."""
    if kind == "auto":
        return F.lit(True)
    return F.coalesce(F.lower(F.regexp_extract(leaf(path), r"^.+(\.[^.]+)$", 1)).isin(*KINDS[kind]), F.lit(False))


def encode_continuation(offset: int) -> str:
    import base64
    import json

    return base64.urlsafe_b64encode(json.dumps({"v": 1, "o": offset}, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_continuation(token: str) -> int:
    """Raises ValueError for anything that encode_continuation() does not give."""
    import base64
    import json

    try:
        got = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
    except Exception as e:
        raise ValueError("malformed continuation") from e
    if not isinstance(got, dict) or got.get("v") != 1 or isinstance(got.get("o"), bool) or not isinstance(got.get("o"), int) or got["o"] < 0:
        raise ValueError("malformed continuation")
    return got["o"]
