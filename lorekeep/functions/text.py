
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

LINK = r"\[\[(.*?)\]\]"
#: PRJ-12: what readers take for front matter, and whether they strip the rest.  Fixed values.
FRONT_MATTER = {
    "chunker": (r"(?ms)^---\n(.*?)\n---(.*)", True),
    "distiller": (r"(?s)\A---\n(.*?)\n---\n(.*)", True),
    "quality": (r"(?s)\A---\n(.*?)\n---\n(.*)", False),
}


def lookup(table: Mapping[str, object], key: Column, default: object) -> Column:
    """A constant table as a map literal, with a default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def lexemes(text: Column) -> Column:
    """SC-5: distinct lower-case alphanumeric tokens, in order of first occurrence."""
    return F.array_distinct(tokens(text))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def split_words(text: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """SC-19: words x 1.3, rounded down."""
    return F.floor(F.size(split_words(text)) * 1.3).cast("long")


def sentences(text: Column) -> Column:
    """SC-14: parts that end in . ! or ? followed by white space (without look-behind)."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def extractive(text: Column, tokens_left: Column) -> Column:
    """SC-15: a text over the budget with more than four sentences becomes its first and last two."""
    s = sentences(text)
    short = F.concat(F.array_join(F.slice(s, 1, 2), " "), F.lit("\n... [Content Compressed] ...\n"), F.array_join(F.slice(s, -2, 2), " "))
    return F.when((token_estimate(text) <= tokens_left) | (F.size(s) <= 4), text).otherwise(short)


def heuristic_summary(text: Column) -> Column:
    """SC-16."""
    s = sentences(text)
    return F.when(F.size(s) <= 2, text).otherwise(F.concat(F.element_at(s, 1), F.lit(" ... [Distilled] ... "), F.element_at(s, -1)))


def truncate_words(text: Column, most: int) -> Column:
    """SC-17: at most ``most`` characters, cut at a space, with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(flat, 1, most)
    at_space = F.rtrim(F.regexp_replace(head, r" [^ ]*$", ""))
    cut = F.when(head.contains(" "), at_space).otherwise(head)
    return F.when(F.length(flat) > most, F.concat(cut, F.lit("..."))).otherwise(flat)


def excerpt(text: Column, most: int) -> Column:
    """SC-27."""
    t = strip(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most), r"\s+$", ""), F.lit("\n\n...")))


def lessons(text: Column) -> Column:
    """SC-18: keyword rules."""
    low = F.lower(text)
    found = F.array(
        F.when(low.contains("error") | low.contains("fail"), "Identified error pattern requiring structural patch."),
        F.when(low.contains("docker"), "Docker environments require port mapping verification."),
        F.when(low.contains("step"), "Sequence of operations detected."),
    )
    return F.filter(found, lambda x: x.isNotNull())


def string_list(values: Column) -> Column:
    """PRJ-4: trimmed, empties dropped, distinct in order (array of string, or of arrays)."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def front_matter(text: Column, reader: str) -> Column:
    """PRJ-12: struct(head, body) as a reader sees a note; without front matter a null head, and the text as it is.

    The chunker takes the first block at the start of any line and drops what is before it; the others only
    one at the start of the text that ends with a line of its own."""
    pattern, stripped = FRONT_MATTER[reader]
    body = F.regexp_extract(text, pattern, 2)
    found = text.rlike(pattern)
    return F.struct(F.when(found, F.regexp_extract(text, pattern, 1)).alias("head"), F.when(found, strip(body) if stripped else body).otherwise(text).alias("body"))


def relationships(rels: Column) -> Column:
    """PRJ-5: maps with alias keys -> (predicate, target, status)."""
    get = lambda m, *keys: F.coalesce(*[m[k] for k in keys])
    made = F.transform(
        rels,
        lambda m: F.struct(
            predicate(get(m, "predicate", "relation", "type")).alias("predicate"),
            clean_link(get(m, "target", "object", "entity")).alias("target"),
            F.coalesce(m["status"], F.lit("explicit")).alias("status"),
        ),
    )
    return F.filter(made, lambda r: (r["predicate"] != "") & (r["target"] != ""))


def memory_type(value: Column) -> Column:
    """PRJ-6: alias -> category, semantic by default."""
    return lookup(vocab.MEMORY_TYPES, F.lower(F.trim(F.coalesce(value, F.lit("")))), "semantic")


def document_status(path: Column, status: Column) -> Column:
    """PRJ-7."""
    return F.when(path.startswith("Archive/") | F.coalesce(F.lower(status).isin("archived", "superseded"), F.lit(False)), "archived").otherwise("active")


def heading_context(headings: Column) -> Column:
    """PRJ-10: a line a heading, with as many # as its level, six at most."""
    return F.array_join(F.transform(headings, lambda h, i: F.concat(F.repeat(F.lit("#"), F.least(i + 1, F.lit(6))), F.lit(" "), h)), "\n")


def links(text: Column) -> Column:
    """PRJ-11: link targets in a text, cleaned, distinct in order."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LINK), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, lambda x: clean_link(x)), lambda x: x != ""))


def tags(text: Column) -> Column:
    """PRJ-11: #tags at the start or after white space."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|\s)#([a-zA-Z0-9_-]+)"), F.lit(1)))


def clean_link(value: Column) -> Column:
    """SC-2: brackets, alias after | and anchor after # are dropped."""
    bare = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"^[\[\]\s]+|[\[\]\s]+$", "")
    return F.trim(F.regexp_replace(bare, r"[|#].*$", ""))


def entity_key(value: Column) -> Column:
    """SC-1 for ASCII: white space collapsed, lower case (``udfs.entity_key`` adds NFKC)."""
    return F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))


def predicate(value: Column) -> Column:
    """SC-3."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"[-\s]+", "_")


def slug(text: Column) -> Column:
    """PRJ-17: lower case, other than alphanumerics as one dash, 72 characters."""
    made = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 72)
    return F.when(made == "", "memory").otherwise(made)


def title(text: Column) -> Column:
    """PRJ-17: the first H1, or the first line with text, 80 characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("---"))
    first = F.get(lines, F.lit(0))
    return F.coalesce(F.when(first.startswith("# "), F.trim(F.substring(first, 3, 1_000_000))).otherwise(F.substring(first, 1, 80)), F.lit("Memory"))


def hash_tags(values: Column) -> Column:
    """PRJ-17: each tag with one leading #."""
    return F.transform(string_list(values), lambda t: F.when(t.startswith("#"), t).otherwise(F.concat(F.lit("#"), t)))


def folder(category: Column) -> Column:
    """PRJ-18."""
    return lookup(vocab.FOLDERS, F.lower(category), "Concepts")


def vault_path(path: Column) -> Column:
    """PRJ-3: a relative path with single slashes; null if it leaves the vault."""
    p = F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), "/+", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"^(\./)+", ""), r"/\./", "/")
    return F.when(p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)"), None).otherwise(p)


def contains_count(text: Column, words: Sequence[str]) -> Column:
    """How many of the words are in a (lower-case) text."""
    return sum((text.contains(w).cast("int") for w in words[1:]), text.contains(words[0]).cast("int"))


def category(text: Column, words: Mapping[str, Sequence[str]] = vocab.CATEGORY_WORDS) -> Column:
    """EP-1: the first category of which a word occurs, else episodic."""
    low, out = F.lower(text), None
    for name, list_ in words.items():
        hit = contains_count(low, list_) > 0
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("episodic")


def intent(query: Column) -> Column:
    """SC-21."""
    low = F.lower(query)
    return F.when(contains_count(low, ["how to", "step", "code", "fix", "debug"]) > 0, "procedural").when(low.contains("summarize"), "summary").otherwise("semantic")


def compression_profile(intent_: Column) -> Column:
    """SC-23."""
    return F.when(intent_ == "procedural", "coding").otherwise("research")


def query_entities(query: Column) -> Column:
    """SC-22: linked names; without any, capitalised words but common ones."""
    linked = F.array_distinct(F.regexp_extract_all(query, F.lit(LINK), F.lit(1)))
    named = F.filter(F.regexp_extract_all(query, F.lit(r"\b([A-Z][a-zA-Z0-9]+)\b"), F.lit(1)), lambda w: ~w.isin("How", "Why", "What", "When", "The", "A"))
    return F.when(F.size(linked) > 0, linked).otherwise(named)


def entity_type(name: Column) -> Column:
    """SC-24."""
    low = F.lower(name)
    return (
        F.when(contains_count(low, ["bug", "error", "issue"]) > 0, "issue")
        .when(contains_count(low, ["fix", "patch"]) > 0, "fix")
        .when(contains_count(low, ["architecture", "system"]) > 0, "architecture")
        .when(contains_count(low, ["how to", "step"]) > 0, "procedure")
        .when((F.initcap(low) == name) & name.contains(" "), "person")
        .otherwise("concept")
    )


def task_terms(task: Column) -> Column:
    """SC-26: distinct tokens of three or more characters, without stop words."""
    found = F.regexp_extract_all(F.lower(task), F.lit("([a-z0-9_]{3,})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*vocab.TASK_STOPS)))


def term_score(text: Column, terms: Column) -> Column:
    """SC-26: occurrences of all terms in the text."""
    low = F.lower(text)
    n = F.aggregate(terms, F.lit(0).cast("long"), lambda acc, t: acc + ((F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)).cast("long"))
    return F.coalesce(n, F.lit(0).cast("long"))


def task_type(prompt: Column) -> Column:
    """SC-28."""
    low = F.lower(prompt)
    return (
        F.when(contains_count(low, ["code", "script", "debug", "error", "refactor", "build"]) > 0, "coding")
        .when(contains_count(low, ["explain", "research", "what is", "why", "how does"]) > 0, "research")
        .otherwise("general")
    )


def insights(response: Column) -> Column:
    """SC-28: (text, category) of what a response states as fix, decision or completion."""
    part = lambda words: F.trim(F.regexp_extract(response, rf"(?is)(?:{words})(.*?)(?:\n\n|$)", 1))
    has = lambda words: response.rlike(f"(?i)(?:{words})")
    fix, decision = "I fixed this by|The solution was|Resolution:", "I have decided to|Decision:"
    item = lambda label, text, kind: F.struct(F.concat(F.lit(label), text).alias("text"), F.lit(kind).alias("category"))
    stated = F.filter(F.array(F.when(has(fix), item("Fix applied: ", part(fix), "procedural")), F.when(has(decision), item("Decision made: ", part(decision), "semantic"))), lambda x: x.isNotNull())
    done = F.lower(response).rlike("successfully|completed")
    first = F.array(item("Task completed: ", F.concat(F.substring_index(response, ".", 1), F.lit(".")), "episodic"))
    return F.when(F.size(stated) > 0, stated).when(done, first).otherwise(stated)


def iso_timestamp(value: Column) -> Column:
    """SC-30: ISO text to a timestamp; null if it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00"))


def clamp(x: Column) -> Column:
    """SC-33: null stays null (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")
