"""Text functions as Columns: tokenizers, normalizers, phrase tests.  All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import lexicon as lx

TOKEN = r"[a-z0-9]+(?:[-_][a-z0-9]+)?"
ENTITY_TOKEN = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?"
SPACES = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
ABBREVIATION = r"\b([A-Za-z][A-Za-z0-9][A-Za-z0-9 -]{3,80}?)\s*\(([A-Z0-9-]{2,12})\)"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def words_in(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(c: Column) -> Column:
    """Index tokens: runs of a-z and 0-9 of the lowered text with at most one inner joiner (FN-01)."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(TOKEN), F.lit(0))


def greek(c: Column) -> Column:
    for letter, name in lx.GREEK.items():
        c = F.replace(c, F.lit(letter), F.lit(name))
    return c


def entity_tokens(c: Column) -> Column:
    """Mention tokens, case kept, Greek letters spelled out (FN-02)."""
    return F.regexp_extract_all(greek(text(c)), F.lit(ENTITY_TOKEN), F.lit(0))


def concept_name(c: Column) -> Column:
    """Canonical name of a concept (FN-03)."""
    low = F.replace(F.lower(greek(text(c))), F.lit("'"), F.lit(""))
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def one_spaced(c: Column) -> Column:
    """White space collapsed to single blanks (FN-04)."""
    return F.trim(F.regexp_replace(text(c), SPACES, " "))


def plain_name(c: Column) -> Column:
    """Lowered alphanumeric runs joined by blanks (FN-05)."""
    return F.array_join(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def singular(t: Column) -> Column:
    """A light plural rule for one token (FN-06)."""
    t = F.lower(t)
    n, drop = F.length(t), lambda k: F.substring(t, F.lit(1), F.length(t) - k)
    ends = lambda *xs: F.lit(False) if not xs else t.rlike("(?:" + "|".join(xs) + ")$")
    return (
        F.when(n <= 3, t)
        .when(ends("ies") & (n > 4), F.concat(drop(3), F.lit("y")))
        .when(ends("ches", "shes", "xes", "ses") & (n > 5), drop(2))
        .when(ends("[sxz]es") & (n > 4), drop(2))
        .when(ends("s") & ~ends("ss", "us", "is"), drop(1))
        .otherwise(t)
    )


def light_name(c: Column, plural: bool = True) -> Column:
    """Concept name with slashes and hyphens opened and plurals dropped (FN-07)."""
    base = concept_name(F.translate(text(c), "/-", "  "))
    parts = F.filter(F.split(base, " "), lambda t: t != "")
    return F.array_join(F.transform(parts, lambda t: singular(t)) if plural else parts, " ")


def variants(c: Column, light: Column | None = None) -> Column:
    """Distinct non-empty spellings of a phrase (FN-07); ``light``: its light name, if at hand."""
    return F.array_distinct(F.filter(F.array(concept_name(c), light_name(c) if light is None else light), lambda v: v != ""))


def abbreviations(c: Column) -> Column:
    """map short form -> long form of ``long form (SHORT)``; the last pair of a short form wins (FN-08)."""
    pair = F.arrays_zip(F.regexp_extract_all(text(c), F.lit(ABBREVIATION), F.lit(2)).alias("s"), F.regexp_extract_all(text(c), F.lit(ABBREVIATION), F.lit(1)).alias("l"))
    named = F.transform(pair, lambda p: F.struct(light_name(p["s"]).alias("s"), light_name(p["l"]).alias("l")))
    named = F.filter(named, lambda p: (p["s"] != "") & (p["l"] != ""))
    last = F.filter(named, lambda p, i: ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named) - i - 1, F.lit(0))), lambda later: later["s"] == p["s"]))
    return F.map_from_entries(last)


def contained(c: Column, phrases: Column, light: Column | None = None) -> Column:
    """How many phrases stand in a text as whole words (FN-09); ``light``: the text's light name, if at hand."""
    padded = F.concat(F.lit(" "), light_name(c) if light is None else light, F.lit(" "))
    names = F.filter(F.transform(phrases, lambda p: light_name(p)), lambda p: p != "")
    return F.size(F.filter(names, lambda p: F.contains(padded, F.concat(F.lit(" "), p, F.lit(" ")))))


def _among(t: Column, values: Sequence[str]) -> Column:
    return t.isin(list(values))


def gene_like(t: Column, stop: Sequence[str] = lx.STOPWORDS, weak: Sequence[str] = lx.LOW_INFORMATION) -> Column:
    """An upper-case symbol of 2 to 12 characters that is no common word (FN-10)."""
    low = F.lower(t)
    return ~_among(low, stop) & ~_among(low, weak) & t.rlike("^[A-Z0-9-]{2,12}$") & t.rlike("[A-Za-z]")


def _suffixed(low: Column, suffixes: Sequence[str]) -> Column:
    return low.rlike("(?:" + "|".join(suffixes) + ")$")


def hinted(ts: Column, terms: Sequence[str] = lx.DOMAIN_TERMS, suffixes: Sequence[str] = lx.DOMAIN_SUFFIXES) -> Column:
    """Some token is a domain word, has a domain suffix or looks like a gene (FN-10)."""
    return F.exists(ts, lambda t: _among(F.lower(t), terms) | _suffixed(F.lower(t), suffixes) | gene_like(t))


def valid_phrase(ts: Column, terms: Sequence[str] = lx.DOMAIN_TERMS, suffixes: Sequence[str] = lx.DOMAIN_SUFFIXES) -> Column:
    """Whether a token n-gram may name a concept (FN-10)."""
    first, low = ts[0], F.lower(ts[0])
    single = F.when((F.length(low) < 3) | _among(low, lx.LOW_INFORMATION), gene_like(first)).otherwise(gene_like(first) | _among(low, terms) | _suffixed(low, suffixes))
    single = single & ~_among(low, lx.STOPWORDS)
    several = ~F.exists(ts, lambda t: _among(F.lower(t), lx.STOPWORDS)) & hinted(ts, terms, suffixes)
    return F.when(F.size(ts) < 1, F.lit(False)).when(F.size(ts) == 1, single).otherwise(several)


def ngrams(ts: Column, most: int = 5) -> Column:
    """All n-grams of 1 to ``most`` tokens, by size and then place (FN-11)."""
    of = lambda n: F.when(F.size(ts) >= n, F.transform(F.sequence(F.lit(1), F.size(ts) - (n - 1)), lambda i: F.slice(ts, i, n))).otherwise(F.array().cast("array<array<string>>"))
    return F.flatten(F.array(*[of(n) for n in range(1, most + 1)]))


def concept_type(canonical: Column, surfaces: Column) -> Column:
    """Type by the first hint set that a word of the name is in (FN-12)."""
    parts = F.split(canonical, " ")
    out = F.when(F.arrays_overlap(parts, words_in(lx.TYPE_HINTS[0][1])), F.lit(lx.TYPE_HINTS[0][0]))
    for name, hints in lx.TYPE_HINTS[1:]:
        out = out.when(F.arrays_overlap(parts, words_in(hints)), F.lit(name))
    return out.when(F.exists(surfaces, lambda t: gene_like(t)), F.lit("gene_or_protein")).otherwise(F.lit("biomedical_concept"))


def stable_id(c: Column, prefix: str = "PMQA_MESH_") -> Column:
    """An id from the first 12 hex digits of the SHA-1 of a term (FN-13)."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(text(c).cast("binary")), 1, 12))


def bucket(qid: Column, modulo: int) -> Column:
    """Digits: the number modulo; else the sum of code points modulo (FN-14)."""
    chars = F.filter(F.split(qid, ""), lambda ch: ch != "")
    codes = F.aggregate(chars, F.lit(0).cast("long"), lambda a, ch: a + F.ascii(ch))
    return F.when(qid.rlike("^[0-9]+$"), F.pmod(qid.cast("decimal(38,0)"), F.lit(modulo)).cast("long")).otherwise(F.pmod(codes, F.lit(modulo)).cast("long"))


def split_of(qid: Column, modulo: int = 5, validation: Sequence[int] = (3,), test: Sequence[int] = (4,)) -> Column:
    """train, validation or test by bucket (FN-15)."""
    b = bucket(qid, modulo)
    return F.when(b.isin(list(validation)), F.lit("validation")).when(b.isin(list(test)), F.lit("test")).otherwise(F.lit("train"))


def evidence_type(c: Column) -> Column:
    """struct(score, label): the best rung of the evidence ladder above 0.5 (FN-26)."""
    rungs = [F.when(F.lower(text(c)).rlike(rx), F.struct(F.lit(s).alias("score"), F.lit(n).alias("label"))) for n, s, rx in lx.EVIDENCE_LADDER if s > 0.5]
    return F.coalesce(F.array_max(F.filter(F.array(*rungs), lambda r: r.isNotNull())), F.struct(F.lit(0.5).alias("score"), F.lit("unspecified").alias("label")))


def question_type(c: Column) -> Column:
    """By prefix (FN-28, the variant of the diagnostics)."""
    t, out = F.lower(F.trim(text(c))), None
    for name, prefixes in lx.QUESTION_PREFIXES:
        test = F.lit(False)
        for p in prefixes:
            test = test | t.startswith(p)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit("other"))


def question_kind(c: Column) -> Column:
    """By prefix (FN-28, the variant of the per-type analysis)."""
    t = F.lower(text(c))
    starts = lambda *xs: F.coalesce(*[F.when(t.startswith(x), F.lit(True)) for x in xs], F.lit(False))
    return (
        F.when(starts("is ", "are ", "do ", "does ", "can ", "will ", "has ", "have ", "is there", "are there"), F.lit("yes/no"))
        .when(starts("list ", "what are ", "which are "), F.lit("list"))
        .when(starts("what is"), F.lit("what_is"))
        .when(starts("which "), F.lit("which"))
        .when(starts("how "), F.lit("how"))
        .otherwise(F.lit("other"))
    )


def _occurrences(c: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a blank-padded phrase."""
    p = f" {phrase} "
    return (F.length(c) - F.length(F.replace(c, F.lit(p), F.lit("")))) / len(p)


def rule_answer(c: Column) -> Column:
    """yes, no or maybe from negations and hedges (FN-29)."""
    t = F.concat(F.lit(" "), F.lower(text(c)), F.lit(" "))
    add = lambda ps: sum((_occurrences(t, p) for p in ps[1:]), _occurrences(t, ps[0]))
    no, maybe = add(lx.NEGATIVE), add(lx.HEDGE)
    return F.when((no > 0) & (no >= maybe), F.lit("no")).when(maybe > 0, F.lit("maybe")).otherwise(F.lit("yes"))


def compact(c: Column, most: int = 900) -> Column:
    """One-spaced prefix (FN-31)."""
    return F.rtrim(F.substring(one_spaced(c), 1, most))


def prompt(question: Column, evidence: Column) -> Column:
    """Prompt over ranked evidence structs (title, text) (FN-31)."""
    lines = F.transform(evidence, lambda e, i: F.concat(F.lit("[P"), (i + 1).cast("string"), F.lit("] "), compact(e["title"], 140), F.lit(". "), compact(e["text"], 900)))
    head = 'Answer the PubMedQA question using only the cited evidence passages.\nChoose exactly one label from: yes, no, maybe.\nReturn strict JSON with keys: answer, citations, rationale.\nThe citations value must be a list of passage ids such as ["P1", "P2"].\n\nQuestion: '
    return F.concat(F.lit(head), text(question), F.lit("\n\nEvidence:\n"), F.array_join(lines, "\n"))


def parsed_answer(c: Column) -> Column:
    """struct(answer, citations, rationale) of a model's reply (FN-32)."""
    clean = F.trim(F.regexp_replace(text(c), r"(?is)<think>.*?</think>", ""))
    body = F.regexp_extract(clean, r"(?s)\{.*\}", 0)
    field = lambda k: F.get_json_object(body, f"$.{k}")
    said = F.lower(F.trim(F.coalesce(field("answer"), F.lit(""))))
    found = F.regexp_extract(F.lower(clean), r"\b(yes|no|maybe)\b", 1)
    answer = F.when(said.isin(lx.ANSWERS), said).when(found != "", found).otherwise(F.lit("maybe"))
    cited = F.coalesce(field("citations"), F.lit(""))
    listed = F.filter(F.transform(F.from_json(cited, "array<string>"), lambda x: F.trim(x)), lambda x: x.rlike(r"^P\d+$"))
    citations = F.when(cited.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.regexp_extract_all(cited, F.lit(r"P\d+"), F.lit(0)))
    return F.struct(answer.alias("answer"), citations.alias("citations"), F.trim(F.coalesce(field("rationale"), F.lit(""))).alias("rationale"))


def content_terms(c: Column, stop: Sequence[str] = lx.STOPWORDS) -> Column:
    """Distinct words of four characters or more that are no stopwords (FN-33)."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z][a-z0-9-]{3,}"), F.lit(0)))
    return F.array_except(found, words_in(stop))


def consistency(rationale: Column, evidence: Column) -> Column:
    """Share of the rationale's terms found in the evidence; null if either has none (FN-33)."""
    a, b = content_terms(rationale), content_terms(evidence)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(a))


def truncated(c: Column, most: int = 360) -> Column:
    """At most ``most`` characters, with an ellipsis (FN-34)."""
    t = one_spaced(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("...")))


def markdown(c: Column) -> Column:
    """Safe inside a Markdown table cell (FN-34)."""
    return F.replace(F.replace(text(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def repeated(c: Column, weight: int) -> Column:
    """A field repeated by its weight (FN-24)."""
    t = F.trim(text(c))
    return F.when(t == "", F.lit("")).otherwise(F.array_join(F.array_repeat(t, weight), " "))


def passage(title: Column, body: Column) -> Column:
    """Title, newline, text; blanks around go (FN-25)."""
    return F.trim(F.concat_ws("\n", text(title), text(body)), F.lit(" \n"))


def keep_descriptor(name: Column, generic: bool = False) -> Column:
    """A descriptor's name has three characters and is not too general (PRJ-13)."""
    n = concept_name(name)
    long = F.length(n) >= 3
    return long if generic else long & ~n.isin(*lx.GENERIC_DESCRIPTORS)


def concept_key(kind: Column, concept_id: Column, allowed: Sequence[str] | None = None) -> Column:
    """type:id of an annotated concept of a known type and a real id, else null (PRJ-13)."""
    k, i = F.replace(F.lower(F.trim(text(kind))), F.lit(" "), F.lit("")), F.trim(text(concept_id))
    fine = k.isin(*lx.CONCEPT_TYPES) & ~F.lower(i).isin(*lx.STOP_CONCEPT_IDS)
    fine = fine if allowed is None else fine & k.isin(*allowed)
    return F.when(fine, F.concat_ws(":", k, i))
