"""Text, date and citation functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.schema import lookup

ARROW = " › "
#: What trailer keys and block directives assert, in lower case.
TRAILER_KINDS = {
    "agentile-implements": "Implements", "agentile-decides": "Decides", "agentile-supersedes": "Supersedes", "agentile-refutes": "Refutes", "agentile-depends-on": "DependsOn",
    "agentile-caused-by": "CausedBy", "agentile-references": "References", "agentile-ref": "References", "agentile-see-also": "References",
}
DIRECTIVE_KINDS = {"implements": "Implements", "decides": "Decides", "supersedes": "Supersedes", "refutes": "Refutes", "depends-on": "DependsOn", "references": "References", "ref": "References", "see-also": "References"}
FENCES = ("```agentile", "~~~agentile")


def lines(text: Column) -> Column:
    """Lines without their ends; no empty line after a last line feed."""
    parts = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"\r$", ""))
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


_FRONT = r"(?s)^---\r?\n((?:(?!---\r?(?:\n|$))[^\n]*\n)*?)---\r?(?:\n|$)"


def frontmatter(text: Column) -> Column:
    """The leading block's `key: value` lines as a map; empty without a closed block.  The last of a key wins."""
    block = F.regexp_extract(text, _FRONT, 1)
    pairs = F.transform(lines(block), lambda x: F.struct(trim(F.substring_index(x, ":", 1)).alias("k"), trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v"), F.contains(x, F.lit(":")).alias("ok")))
    good = F.filter(pairs, lambda p: p["ok"] & (p["k"] != ""))
    last = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def body(text: Column) -> Column:
    """What follows the frontmatter, or all of the text."""
    return F.regexp_replace(text, _FRONT, "")


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar; a day beyond its month rolls over."""
    first = F.unix_date(F.make_date(y, m, F.lit(1)))
    return first + d - 1


def iso_ms(text: Column) -> Column:
    """Epoch milliseconds of a date, or date and time; `+hh:mm` is ignored, `-hh:mm` and malformed text are null."""
    t = trim(text)
    split = F.regexp_extract(t, r"^([^T]*)T", 0) != ""
    date = F.when(split, F.substring_index(t, "T", 1)).when(F.contains(t, F.lit(" ")), F.substring_index(t, " ", 1)).otherwise(t)
    rest = F.when(split, F.regexp_replace(t, r"^[^T]*T", "")).when(F.contains(t, F.lit(" ")), F.regexp_replace(t, r"^[^ ]* ", "")).otherwise(F.lit(""))
    clock = F.substring_index(F.substring_index(F.regexp_replace(rest, "Z+$", ""), "+", 1), ".", 1)
    ymd = r"^\+?(\d{1,9})-\+?(\d{1,9})-\+?(\d{1,9})$"
    hms = r"^\+?(\d{1,9})(?::\+?(\d{1,9}))?(?::\+?(\d{1,9}))?$"
    part = lambda c, p, k: F.coalesce(F.nullif(F.regexp_extract(c, p, k), F.lit("")).cast("int"), F.lit(0))
    y, m, d = (part(date, ymd, k) for k in (1, 2, 3))
    h, mi, s = (part(clock, hms, k) for k in (1, 2, 3))
    fine = date.rlike(ymd) & m.between(1, 12) & d.between(1, 31) & ((clock == "") | (clock.rlike(hms) & (h < 24) & (mi < 60) & (s < 60)))
    ms = (days_from_civil(y, F.when(fine, m).otherwise(1), d).cast("long") * 86400 + h * 3600 + mi * 60 + s) * 1000
    return F.when(fine & (ms >= 0), ms)


def _pair(line: Column) -> Column:
    return F.struct(trim(F.substring_index(line, ":", 1)).alias("key"), trim(F.regexp_replace(line, r"^[^:]*:", "")).alias("value"))


def _is_pair(line: Column) -> Column:
    return line.rlike(r"(?U)^\s*[A-Za-z][A-Za-z0-9_-]*\s*:\s*\S")


def trailers(text: Column) -> Column:
    """Key-value pairs of the last paragraph, if all of its lines that are not blank are pairs; else none."""
    blocks = F.filter(F.split(text, "\n\n", -1), lambda b: trim(b) != "")
    last = F.when(F.size(blocks) > 0, F.element_at(blocks, -1)).otherwise(F.lit(""))
    own = F.filter(lines(last), lambda x: trim(x) != "")
    return F.when(F.forall(own, _is_pair), F.transform(own, _pair)).otherwise(F.array().cast("array<struct<key:string,value:string>>"))


def directive_blocks(text: Column) -> Column:
    """Key-value pairs in all fenced directive blocks, in order."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("found"))

    def step(s, line):
        t = trim(line)
        opens, closes = ~s["inside"] & t.isin(*FENCES), s["inside"] & t.isin("```", "~~~")
        keep = s["inside"] & ~closes & _is_pair(line)
        return F.struct((opens | (s["inside"] & ~closes)).alias("inside"), F.when(keep, F.concat(s["found"], F.array(line))).otherwise(s["found"]).alias("found"))

    return F.transform(F.aggregate(lines(text), start, step)["found"], _pair)


def trailer_kind(key: Column) -> Column:
    return lookup(F.lower(key), TRAILER_KINDS)


def directive_kind(key: Column) -> Column:
    return lookup(F.lower(key), DIRECTIVE_KINDS)


def classify(path: Column, fm: Column, text: Column) -> Column:
    """A document's node kind by an explicit claim, its path, or its frontmatter."""
    p = F.concat(F.lit("/"), F.lower(path))
    file = F.substring_index(p, "/", -1)
    pairs = directive_blocks(text)
    of = lambda name: F.filter(pairs, lambda x: F.lower(x["key"]) == name)
    claim = F.exists(of("node"), lambda x: F.lower(x["value"]) == "claim")
    state = F.lower(F.try_element_at(of("claim-status"), F.lit(1))["value"])
    has = lambda *parts: F.greatest(*[F.contains(p, F.lit(x)) for x in parts], F.lit(False), F.lit(False))
    closed = F.contains(file, F.lit("retro")) | F.coalesce(F.try_element_at(fm, F.lit("status")) == "archived", F.lit(False))
    return (
        F.when(claim & state.isin("confirmed", "corrected", "refined"), F.concat(F.lit("claim:"), state))
        .when(F.startswith(file, F.lit("adr-")) | has("/adrs/"), "adr")
        .when(has("/sprints/") | F.map_contains_key(fm, "sprint"), F.when(closed, "sprint:close").otherwise("sprint:kickoff"))
        .when(has("/journal/", "/journals/"), "narrative:journal")
        .when(has("/essays/"), "narrative:essay")
        .when(has("/case_studies/", "/case-studies/"), "narrative:casestudy")
        .when(has("/handoffs/") | F.contains(file, F.lit("handoff")), "handoff")
        .otherwise("doc")
    )


def _first_heading(all_lines: Column, pattern: str) -> Column:
    found = F.filter(F.transform(all_lines, lambda x: trim(F.regexp_extract(x, pattern, 1))), lambda x: x != "")
    return F.try_element_at(found, F.lit(1))


def doc_title(path: Column, fm: Column, text: Column) -> Column:
    """First `# ` line, else frontmatter title (or, without one, sprint), else the file's stem."""
    named = F.nullif(F.coalesce(F.try_element_at(fm, F.lit("title")), F.try_element_at(fm, F.lit("sprint"))), F.lit(""))
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(\.md)+$", "")
    return F.coalesce(_first_heading(lines(text), r"(?U)^\s*# (.*)$"), named, stem)


def outside_fences(text: Column) -> Column:
    """Lines that are neither fences nor within them."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("found"))

    def step(s, line):
        fence = line.rlike(r"(?U)^\s*(```|~~~)")
        return F.struct((s["inside"] != fence).alias("inside"), F.when(~fence & ~s["inside"], F.concat(s["found"], F.array(line))).otherwise(s["found"]).alias("found"))

    return F.aggregate(lines(text), start, step)["found"]


def corpus_title(path: Column, fm_title: Column, text: Column) -> Column:
    """First `# ` or `= ` heading outside fences, else the frontmatter's title without quotes, else the stem."""
    file = F.substring_index(path, "/", -1)
    stem = F.regexp_extract(file, r"^(.+)\.[^.]*$", 1)
    named = F.regexp_replace(F.nullif(trim(fm_title), F.lit("")), '^"+|"+$', "")
    return F.coalesce(_first_heading(outside_fences(text), r"(?U)^\s*[#=] (.*)$"), named, F.nullif(stem, F.lit("")), file)


def status_of(fm: Column) -> Column:
    return lookup(F.try_element_at(fm, F.lit("status")), {"superseded": "Superseded", "archived": "Archived"}, "Active")


def slug(heading: Column) -> Column:
    """Lower case; letters, numbers, white space, `_` and `-` stay, and white space becomes `-`."""
    kept = F.regexp_replace(F.lower(trim(heading)), r"(?U)[^\p{IsAlphabetic}\p{N}\s_-]", "")
    return F.regexp_replace(kept, r"(?U)\s", "-")


def section_anchor(content: Column) -> Column:
    """Slug of what follows the last breadcrumb mark on line 1; null without one."""
    first = F.try_element_at(lines(content), F.lit(1))
    return F.when(F.contains(first, F.lit(ARROW)), F.nullif(slug(F.substring_index(first, ARROW, -1)), F.lit("")))


def cite(ref: Column, content: Column) -> Column:
    """`repo:path#anchor` of an artifact; null for other sources."""
    anchor = section_anchor(content)
    place = F.concat(ref["repo"], F.lit(":"), ref["path"])
    return F.when(ref["tag"] == "artifact", F.when(anchor.isNull(), place).otherwise(F.concat(place, F.lit("#"), anchor)))


def repo_relative(prefix: Column, rel: Column) -> Column:
    p = F.regexp_replace(prefix, "^/+|/+$", "")
    return F.when(p == "", rel).otherwise(F.concat(p, F.lit("/"), rel))


def safe_repo_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9._-]{1,100}$") & ~name.isin(".", "..")


def safe_relative_path(path: Column) -> Column:
    """Not empty or absolute, no backslash, no `..` part."""
    return (path != "") & ~F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("\\")) & ~path.rlike(r"(^|/)\.\.(/|$)")


def normalise_hex(text: Column) -> Column:
    return F.lower(trim(text))


def logical_key(key: Column) -> Column:
    """A key without what follows its last `@`."""
    return F.regexp_replace(key, "@[^@]*$", "")


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def preview(text: Column) -> Column:
    return F.substring(text, 1, 512)
