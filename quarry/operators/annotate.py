"""Concept annotation: dictionaries, greedy matching, containment joins, concept indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import lexicon as lx
from quarry.functions import text
from quarry.operators import automaton, phrases
from quarry.operators.frames import ranked, small, top
from quarry.operators.store import saved


STRETCH = 1024  # tokens in whose n-grams a row looks at a time


def _stretches(corpus: DataFrame, key: str, longest: int) -> DataFrame:
    """key, w (tokens of a stretch and, behind it, what its last n-grams need), n (tokens that n-grams start at),
    whole (whether it is the only stretch of its text)."""
    held = corpus.select(key, text.entity_tokens(F.col("text")).alias("ts")).where(F.size("ts") > 0)
    cut = held.select(key, "ts", F.explode(F.sequence(F.lit(1), F.size("ts"), F.lit(STRETCH))).alias("i"))
    return cut.select(key, F.slice("ts", F.col("i"), STRETCH + longest - 1).alias("w"), F.least(F.size("ts") - F.col("i") + 1, F.lit(STRETCH)).alias("n"), (F.size("ts") <= STRETCH).alias("whole"))


def _grams(longest: int, valid) -> Column:
    """All valid n-grams that start in a stretch."""
    at = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - i + 1)), lambda k: F.slice(F.col("w"), i, k))
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(1), F.col("n")), at)), lambda g: valid(g))


def _document_counts(stretches: DataFrame, key: str, longest: int, valid) -> DataFrame:
    """canonical, df: in how many texts a name stands.  Of a text in one stretch the distinct names are taken where it
    lies; only names of longer texts are made distinct by a shuffle."""
    names = F.array_distinct(F.transform(_grams(longest, valid), lambda g: text.concept_name(F.array_join(g, " "))))
    short = stretches.where("whole").select(F.explode(names).alias("canonical"))
    long = stretches.where("NOT whole").select(key, F.explode(names).alias("canonical")).distinct().select("canonical")
    return short.unionByName(long).where("canonical <> ''").groupBy("canonical").agg(F.count("*").alias("df"))


def build_dictionary(corpus: DataFrame, key: str = "passage_id", least: int = 3, most: int = 50_000, longest: int = 5, required: DataFrame | None = None, valid=text.valid_phrase, marks: phrases.Marks | None = None) -> DataFrame:
    """entity_id, canonical, surface_forms (5 at most), document_frequency, entity_type (AGG-08).  ``key`` names a row.

    Names are counted first, one for each text they stand in: a text's repeats go before anything is shuffled, and tasks
    hand on sums.  Spellings are counted in a second pass, of the names that are kept only.  ``marks`` in the place of
    ``valid`` says of each token what it makes of an n-gram; names are then counted by numbers (see phrases).
    """
    extra = None
    if required is not None:
        extra = required.select(text.concept_name(F.col("term")).alias("canonical"), F.col("term").alias("surface")).where("canonical <> ''")
    if marks is not None:
        counts, spelled = phrases.counted(corpus, marks, least, most, longest, None if extra is None else extra.select("canonical").distinct())
    else:
        counts = _document_counts(_stretches(corpus, key, longest), key, longest, valid)
    counts = counts.withColumn("req", F.lit(False))
    if extra is not None:
        counts = counts.unionByName(extra.select("canonical", F.lit(least).cast("long").alias("df"), F.lit(True).alias("req"))).groupBy("canonical").agg(F.max("df").alias("df"), F.max("req").alias("req"))
    kept = counts.where(F.col("req") | ((F.col("df") >= least) & (F.length("canonical") >= 3) & ~F.col("canonical").isin(lx.STOPWORDS)))
    best = saved(kept.orderBy(F.desc("req"), F.desc("df"), "canonical").limit(most), "dictionary-names")  # bounded by ``most``
    if marks is None:
        grams = _stretches(corpus, key, longest).select(F.explode(_grams(longest, valid)).alias("g"))
        spelled = grams.select(F.array_join("g", " ").alias("surface"), F.lit(1).cast("long").alias("n")).withColumn("canonical", text.concept_name(F.col("surface")))
    surfaces = spelled.join(small(best.select("canonical")), "canonical", "left_semi").groupBy("canonical", "surface").agg(F.sum("n").alias("n"))
    if extra is not None:
        wanted = extra.join(small(best.select("canonical")), "canonical", "left_semi")
        surfaces = surfaces.unionByName(wanted.withColumn("n", F.lit(1).cast("long"))).groupBy("canonical", "surface").agg(F.sum("n").alias("n"))
    numbered = ranked(best.withColumn("_s", F.lit(0)), "_s", F.desc("df"), "canonical", name="i")
    forms = top(surfaces, "canonical", 5, F.desc("n"), "surface", name="r")
    forms = forms.groupBy("canonical").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "surface"))), lambda x: x["surface"]).alias("surface_forms"))
    rows = numbered.join(forms, "canonical", "left").withColumn("surface_forms", F.coalesce("surface_forms", F.array().cast("array<string>")))
    return rows.select(F.format_string("E%07d", F.col("i") - 1).alias("entity_id"), "canonical", "surface_forms", F.col("df").alias("document_frequency"), text.concept_type(F.col("canonical"), F.col("surface_forms")).alias("entity_type"))


def spans(corpus: DataFrame, dictionary: DataFrame, key: str = "passage_id") -> DataFrame:
    """All places where an entry's tokens stand: an equi-join on the first token, then slices are compared (JN-13)."""
    entries = dictionary.select("entity_id", "canonical", "entity_type", F.split("canonical", " ").alias("ets")).withColumn("first", F.col("ets")[0])
    rows = corpus.select(key, F.transform(text.entity_tokens(F.col("text")), lambda t: F.lower(t)).alias("ts"))
    each = rows.select(key, "ts", F.posexplode("ts").alias("start", "first")).join(small(entries), "first")
    return each.where(F.slice("ts", F.col("start") + 1, F.size("ets")) == F.col("ets")).select(key, "start", (F.col("start") + F.size("ets")).alias("end"), "entity_id", "canonical", "entity_type")


def greedy(found: DataFrame, key: str, most: int = 128, once: bool = False) -> DataFrame:
    """Leftmost, longest spans that do not overlap, folded in order; ``once``: an entity only once (JN-13, JN-14)."""
    got = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("e"), "canonical", "entity_id", "entity_type"))).alias("s"))
    kind = "array<struct<start:int,e:int,canonical:string,entity_id:string,entity_type:string>>"
    zero = F.struct(F.lit(0).alias("free"), F.array().cast(kind).alias("kept"))

    def step(state: Column, s: Column) -> Column:
        ok = (s["start"] >= state["free"]) & (F.size(state["kept"]) < most)
        if once:
            ok = ok & ~F.exists(state["kept"], lambda k: k["entity_id"] == s["entity_id"])
        return F.when(ok, F.struct((-s["e"]).alias("free"), F.concat(state["kept"], F.array(s)).alias("kept"))).otherwise(state)

    kept = got.select(key, F.explode(F.aggregate("s", zero, step, lambda st: st["kept"])).alias("m"))
    return kept.select(key, "m.entity_id", "m.canonical", "m.entity_type", F.col("m.start").alias("start_token"), (-F.col("m.e")).alias("end_token"))


def matches(corpus: DataFrame, dictionary: DataFrame, key: str = "passage_id", most: int = 128, once: bool = False) -> DataFrame:
    """greedy() over spans(): by an automaton in one pass over the texts, unless the dictionary has too many entries to
    be sent to the tasks; then by the join (JN-13, JN-14)."""
    if dictionary.limit(automaton.ENTRIES + 1).count() > automaton.ENTRIES:
        return greedy(spans(corpus, dictionary, key), key, most, once)
    rows = corpus.select(key, F.transform(text.entity_tokens(F.col("text")), lambda t: F.lower(t)).alias("ts"))
    return automaton.matched(rows, dictionary, key, most, once)


def contained_terms(questions: DataFrame, terms: DataFrame, most: int = 32) -> DataFrame:
    """Terms (term_id, normalized) that a question contains, as a phrase or with all of its two to five tokens.

    Candidates meet on the term's longest token, so texts are compared for those only (JN-11, JN-12).
    """
    ts = F.split("normalized", " ")
    longest = F.array_max(F.transform(ts, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    entries = terms.where("normalized <> ''").select("term_id", "normalized", ts.alias("tt"), longest.alias("block"))
    asked = questions.select("question_id", text.concept_name(F.col("question")).alias("qn")).withColumn("qt", F.array_distinct(F.split("qn", " ")))
    each = asked.select("question_id", "qn", "qt", F.explode("qt").alias("block")).join(small(entries), "block")
    exact = F.contains(F.concat(F.lit(" "), "qn", F.lit(" ")), F.concat(F.lit(" "), "normalized", F.lit(" ")))
    every = F.size("tt").between(2, 5) & (F.size(F.array_except("tt", "qt")) == 0)
    hit = each.where(exact | every).withColumn("match_type", F.when(exact, "exact").otherwise("token_set"))
    one = top(hit, ["question_id", "term_id"], 1, F.when(F.col("match_type") == "exact", 0).otherwise(1), F.desc(F.length("normalized")), "normalized", name="_n").drop("_n")
    return top(one, "question_id", most, F.desc(F.length("normalized")), "term_id", name="place").select("question_id", "term_id", "normalized", "match_type", "place")


def lexicon(annotations: DataFrame, length: int = 3) -> DataFrame:
    """Distinct (type, lower name) of names and mentions with the smallest concept id; longest names first by
    ``place`` order (-length, name, type) (AGG-11)."""
    each = annotations.select("type", "concept_id", F.explode(F.array("name", "mention")).alias("n")).select("type", "concept_id", F.lower(F.trim("n")).alias("name")).where(F.length("name") >= length)
    return each.groupBy("type", "name").agg(F.min("concept_id").alias("concept_id"))


def mentions(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """Lexicon entries (type, name, concept_id) whose name stands in a question, bounded by no letter or digit; of
    several names of a concept the shortest, the last by name (JN-15).

    Names meet questions on their first run of letters and digits, so a name is looked for in few questions only.
    """
    word = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    named = entries.select("type", "concept_id", F.lower("name").alias("name")).withColumn("key", F.get(word(F.col("name")), F.lit(0))).where("key IS NOT NULL")
    asked = questions.select("question_id", F.lower("question").alias("low"), F.explode(F.array_distinct(word(F.col("question")))).alias("key"))
    near = asked.join(small(named), "key").where(F.contains("low", "name"))
    quoted = F.regexp_replace("name", r"([^a-z0-9 ])", r"\\$1")
    hit = near.where(F.rlike("low", F.concat(F.lit("(?<![A-Za-z0-9])"), quoted, F.lit("(?![A-Za-z0-9])"))))
    return top(hit, ["question_id", "type", "concept_id"], 1, F.length("name"), F.desc("name"), name="_n").select("question_id", "type", "concept_id", "name")


def mesh_records(annotations: DataFrame, synonyms: DataFrame, generic: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the descriptors of each record, and of each descriptor how many records have it) (AGG-10).

    annotations (passage_id, place, descriptor_ui, descriptor_name, major_topic): of a descriptor that repeats in a
    record the first place counts.  synonyms (mesh_ui, variants); a descriptor without any has its own name.
    """
    rows = annotations.select("passage_id", "place", F.trim("descriptor_ui").alias("mesh_ui"), F.trim("descriptor_name").alias("mesh_name"), F.coalesce("major_topic", F.lit(False)).alias("major"))
    rows = top(rows.where((F.col("mesh_ui") != "") & text.keep_descriptor(F.col("mesh_name"), generic)), ["passage_id", "mesh_ui"], 1, "place", F.desc("major"), "mesh_name", name="_n").drop("_n")
    rows = rows.withColumn("normalized", text.concept_name(F.col("mesh_name"))).join(small(synonyms), "mesh_ui", "left")
    rows = rows.withColumn("variants", F.coalesce("variants", F.array("normalized")))
    return rows, rows.groupBy("mesh_ui").agg(F.count("*").alias("records"))


def concept_index(bags: DataFrame) -> DataFrame:
    """concept, df (AGG-06, AGG-07): postings stay in long form, so a common concept is never one row."""
    return bags.groupBy("concept").agg(F.countDistinct("passage_id").alias("df"))


def frequent(bags: DataFrame, least: int) -> DataFrame:
    """Concepts of questions that occur often enough (AGG-09)."""
    return bags.groupBy("concept").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def coverage(corpus: DataFrame, annotations: DataFrame, key: str = "passage_id", item: str = "concept") -> DataFrame:
    """Share of records with annotations, mean, most, distinct (AGG-20, AGG-21)."""
    per = annotations.groupBy(key).agg(F.count("*").alias("n"))
    rows = corpus.select(key).join(per, key, "left").agg(F.count("*").alias("records"), F.avg(F.col("n").isNotNull().cast("double")).alias("coverage"), F.avg(F.coalesce("n", F.lit(0)).cast("double")).alias("mean"), F.max(F.coalesce("n", F.lit(0))).alias("most"))
    return rows.crossJoin(annotations.agg(F.countDistinct(item).alias("distinct_items")))


def overlap(a: Column, b: Column) -> Column:
    """struct(count, jaccard, coverage of a) of two arrays as sets (SET-01)."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.struct(both.alias("count"), F.coalesce(F.try_divide(both, either), F.lit(0.0)).alias("jaccard"), F.coalesce(F.try_divide(both, F.size(F.array_distinct(a))), F.lit(0.0)).alias("coverage"))


def relations(edges: DataFrame, entities: DataFrame, most: int = 3) -> DataFrame:
    """Undirected relations between dictionary entities (JN-16, JN-17): endpoint names meet entities by normalized
    name, at most ``most`` each; both directions of a pair count once for each relation."""
    names = top(entities.select("entity_id", "canonical"), "canonical", most, "entity_id", name="_n").drop("_n")
    end = lambda side: names.select(F.col("entity_id").alias(f"{side}_id"), F.col("canonical").alias(f"{side}_c"))
    rows = edges.withColumn("source_c", text.concept_name(F.col("source"))).withColumn("target_c", text.concept_name(F.col("target")))
    rows = rows.join(small(end("source")), "source_c").join(small(end("target")), "target_c").where("source_id <> target_id")
    return rows.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), "relation").distinct()


def adjacency(pairs: DataFrame) -> DataFrame:
    """Both orientations of undirected pairs (JN-17, JN-18)."""
    return pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), "relation").unionByName(pairs.select(F.col("b").alias("source"), F.col("a").alias("target"), "relation"))
