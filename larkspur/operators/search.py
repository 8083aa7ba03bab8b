"""Catalogue search over many queries at once: intent, lexical, structured and vector retrieval, fusion, reranking.

Queries are a relation (query_id, text); an index is a relation; one plan answers all. Taxonomy and query tables are
small by nature and joined by broadcast only after a count has shown them so.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import taxonomy
from larkspur.functions.scalar import ranked9, rrf, section_family
from larkspur.functions.text import one_edit, tokens
from larkspur.operators.folds import top_rank
from larkspur.operators.text_vectors import TextIndex, picture_query
from larkspur.operators.vectors import as_vectors, exact_neighbours

K1, B = 1.5, 0.75
#: Weights of the channels, of attributes and of personal preference.
WEIGHTS = {"bm25": 0.45, "semantic": 0.35, "structured": 0.20, "visual": 0.25}
ATTRIBUTES, PERSONAL, UNRANKED = 0.15, 0.08, 10_000
MAX_TERMS, MAX_LENGTH = 8, 160


# --------------------------------------------------------------------------- intent


def alias_table(spark: SparkSession, colours: Mapping[str, str] = taxonomy.COLOURS, types: Mapping[str, str] = taxonomy.TYPES, sections: Mapping[str, str] = taxonomy.SECTIONS) -> DataFrame:
    """(alias, dimension, value)."""
    rows = [(a, d, v) for d, table in (("color", colours), ("product_type", types), ("section", sections)) for a, v in table.items()]
    return spark.createDataFrame(rows, "alias string, dimension string, value string")


def catalogue_aliases(articles: DataFrame) -> DataFrame:
    """Aliases from a catalogue's own one-word colours and types."""
    cells = F.explode(F.array(F.struct(F.lit("color").alias("dimension"), F.col("colour_group_name").alias("value")), F.struct(F.lit("product_type").alias("dimension"), F.col("product_type_name").alias("value")))).alias("c")
    return articles.select(cells).select("c.*").distinct().filter("value <> ''").select(F.lower("value").alias("alias"), "dimension", "value")


def query_tokens(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.posexplode(tokens(F.col("text"))).alias("position", "token"))


def corrected_tokens(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, position, token, corrected): a token within one edit of exactly one alias becomes it; shorter than three letters it stays."""
    names = F.broadcast(aliases.select("alias").distinct())
    t = query_tokens(queries)
    words = t.select("token").distinct()
    unknown = words.filter(F.length("token") >= 3).join(names, F.col("token") == F.col("alias"), "left_anti")
    near = unknown.join(names, (F.abs(F.length("token") - F.length("alias")) <= 1) & one_edit(F.col("token"), F.col("alias")))
    single = near.groupBy("token").agg(F.min("alias").alias("_to"), F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    return t.join(single, "token", "left").select("query_id", "position", "token", F.coalesce("_to", "token").alias("corrected"))


def parse_intent(queries: DataFrame, aliases: DataFrame, styles: Sequence[str] = taxonomy.STYLES, negations: Sequence[str] = taxonomy.NEGATIONS) -> DataFrame:
    """A line per query: the first colour, type and section named; wanted and unwanted styles; which of them are hard.

    A type is hard, a section too, a colour only beside a type. A style after a negation (up to three tokens before) is unwanted.
    """
    t = corrected_tokens(queries, aliases)
    first = t.join(F.broadcast(aliases), F.col("corrected") == F.col("alias")).groupBy("query_id").pivot("dimension", ["color", "product_type", "section"]).agg(F.min_by("value", "position"))
    words = t.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "corrected", "token"))).alias("_t"))
    words = words.select("query_id", F.col("_t.corrected").alias("_c"), F.col("_t.token").alias("tokens"))
    no = F.array(*[F.lit(x) for x in negations])
    listed = F.array(*[F.lit(x) for x in styles])
    at = F.transform("_c", lambda x, i: F.struct(x.alias("w"), F.arrays_overlap(F.slice(F.col("_c"), F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), no).alias("neg")))
    found = F.filter(at, lambda x: F.array_contains(listed, x["w"]))
    out = queries.select("query_id", F.trim("text").alias("free_text")).join(words, "query_id", "left").join(first, "query_id", "left")
    return out.select(
        "query_id",
        "free_text",
        F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"),
        F.coalesce(F.array_join("_c", " "), F.lit("")).alias("semantic_query"),
        "color",
        "product_type",
        "section",
        F.coalesce(F.array_join(F.transform(F.filter(found, lambda x: ~x["neg"]), lambda x: x["w"]), " "), F.lit("")).alias("style_terms"),
        F.coalesce(F.array_join(F.transform(F.filter(found, lambda x: x["neg"]), lambda x: x["w"]), " "), F.lit("")).alias("exclusions"),
        (F.col("color").isNotNull() & F.col("product_type").isNotNull()).alias("hard_color"),
    )


def needs_enrichment(intents: DataFrame, known: DataFrame) -> DataFrame:
    """Queries with a token outside the known words (one column, ``word``)."""
    t = intents.select("query_id", F.explode("tokens").alias("word"))
    return t.join(known.select("word").distinct(), "word", "left_anti").select("query_id").distinct()


_TOKEN = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)?")
#: What a suggested phrase must be, by the complaint about it.
_PHRASE_CHECKS: dict[str, Callable[[str, set[str]], bool]] = {
    "has no words": lambda text, _: bool(_TOKEN.search(text)),
    "is too long": lambda text, _: len(re.sub(r"\s+", " ", text).strip()) <= MAX_LENGTH,
    "holds an article number": lambda text, _: not re.search(r"\b[0-9]{6,}\b", text),
    "has words that are not allowed": lambda text, allowed: set(_TOKEN.findall(text)) <= allowed,
}
#: The fields of a suggestion, and whether each holds one phrase or a short list.
_SUGGESTED = {"reformulated_query": False, "style_terms": True, "exclusions": True}


def soft_text(value: object, allowed: set[str]) -> str:
    """The words of one suggested phrase; raises with all that is wrong with it."""
    text = value.lower() if isinstance(value, str) else ""
    if wrong := [name for name, fits in _PHRASE_CHECKS.items() if not fits(text, allowed)]:
        raise ValueError(f"the suggestion {value!r} {' and '.join(wrong)}")
    return " ".join(_TOKEN.findall(text))


def soft_intent(payload: object, allowed: set[str], query: Sequence[str], aliases: set[str]) -> dict[str, object]:
    """A checked suggestion of an external model. It can't name taxonomy words that the query lacks."""
    if not isinstance(payload, dict) or payload.keys() != _SUGGESTED.keys():
        raise ValueError(f"a suggestion has the fields {', '.join(_SUGGESTED)} and no others")
    usable = {w for w in {*allowed, *query} if w in query or w not in aliases}

    def checked(field: str, listed: bool) -> object:
        value = payload[field]
        if not listed:
            return value if value is None else soft_text(value, usable)
        if not isinstance(value, list) or len(value) > MAX_TERMS:
            raise ValueError(f"{field} must be a list of at most {MAX_TERMS}")
        return list({soft_text(v, usable): None for v in value})

    return {field: checked(field, listed) for field, listed in _SUGGESTED.items()}


def _with_new(text: object, phrases: Sequence[str]) -> str:
    """A text and those phrases after it that it doesn't have yet as a whole word or phrase."""
    parts = dict.fromkeys(str(text).split())
    return " ".join({**parts, **dict.fromkeys(phrases)})


def merge_soft(intent: Mapping[str, object], soft: Mapping[str, object]) -> dict[str, object]:
    """An intent with a checked suggestion added; what is hard stays as it was."""
    asked = str(intent["semantic_query"])
    rewording = [] if set(_TOKEN.findall(soft["reformulated_query"] or "")) <= set(asked.split()) else [soft["reformulated_query"]]
    reworded = " ".join([asked, *rewording]).strip()
    return {
        **intent,
        "style_terms": _with_new(intent["style_terms"], soft["style_terms"]),
        "exclusions": _with_new(intent["exclusions"], soft["exclusions"]),
        "semantic_query": " ".join([reworded, *(t for t in soft["style_terms"] if t not in reworded.split())]).strip(),
    }


# --------------------------------------------------------------------------- lexical


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(doc, token, tf)."""
    return docs.select(F.col(id_col).alias("doc"), F.explode(tokens(text)).alias("token")).groupBy("doc", "token").agg(F.count(F.lit(1)).alias("tf"))


def bm25_index(docs: DataFrame, id_col: str, text: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, terms with document frequency and idf, documents with length). Empty documents count in N and in the mean."""
    p = postings(docs, id_col, text)
    length = docs.select(F.col(id_col).alias("doc"), F.size(tokens(text)).alias("length"))
    n = F.broadcast(docs.agg(F.count(F.lit(1)).alias("n")))
    df = p.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(n)
    return p, df.select("token", "df", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), length


def bm25_search(queries: DataFrame, docs: DataFrame, id_col: str, text: Column, k: int = 200) -> DataFrame:
    """(query_id, doc, score, rank). A token that a query repeats counts as often. Only the queries' tokens are looked up.

    Postings and lengths have lines for each word and document, whatever the files' size, and are never broadcast.
    """
    p, terms, length = bm25_index(docs, id_col, text)
    wanted = query_tokens(queries).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    mean = F.broadcast(length.agg(F.avg("length").alias("mean_length")))
    hits = wanted.join(terms, "token").join(p.hint("merge"), "token").join(length.hint("merge"), "doc").crossJoin(mean)
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = hits.groupBy("query_id", "doc").agg(F.sum(part).alias("score"))
    return top_rank(scored, ["query_id"], [ranked9(F.col("score")).desc(), "doc"], k)


# --------------------------------------------------------------------------- structured


def colour_match(colour: Column, *fields: Column) -> Column:
    return F.array_contains(F.array(*[F.lower(F.coalesce(f, F.lit(""))) for f in fields]), F.lower(colour))


def _parts(intent: str = "") -> tuple[Column, Column, Column]:
    """Whether an article has the intent's type, colour, section; false where the intent has none."""
    no = F.lit(False)
    kind = F.coalesce(F.col("product_type") == F.col("product_type_name"), no)
    colour = F.coalesce(colour_match(F.col("color"), F.col("colour_group_name")), no)
    family = F.coalesce(F.col("section") == section_family(F.col("section_name")), no)
    return kind, colour, family


def structured_search(intents: DataFrame, articles: DataFrame, k: int = 400) -> DataFrame:
    """Articles that fit every named dimension the catalogue knows; 2 for the type, 1 for colour, 1 for section.

    A name that no article has is passed over here (the hard filter later turns everything away). The join is on the named type
    or colour where there is one, never each query with each article.
    """
    a = articles.select("article_id", "product_type_name", "colour_group_name", "section_name")
    known = lambda c, name: a.select(F.col(c).alias(name)).filter(F.col(name) != "").distinct()
    i = intents.select("query_id", "product_type", "color", "section")
    i = i.join(known("product_type_name", "_t"), F.col("product_type") == F.col("_t"), "left").join(known("colour_group_name", "_c"), F.col("color") == F.col("_c"), "left")
    fam = a.select(section_family(F.col("section_name")).alias("_f")).filter("_f <> ''").distinct()
    i = i.join(fam, F.col("section") == F.col("_f"), "left").filter("_t IS NOT NULL OR _c IS NOT NULL OR _f IS NOT NULL")
    keyed = i.withColumn("_key", F.coalesce(F.concat(F.lit("t:"), "_t"), F.concat(F.lit("c:"), "_c"), F.concat(F.lit("f:"), "_f")))
    keys = F.explode(F.array(F.concat(F.lit("t:"), "product_type_name"), F.concat(F.lit("c:"), "colour_group_name"), F.concat(F.lit("f:"), section_family(F.col("section_name"))))).alias("_key")
    both = keyed.join(a.select("*", keys).hint("merge"), "_key")
    fits = (F.col("_t").isNull() | (F.col("_t") == F.col("product_type_name"))) & (F.col("_c").isNull() | (F.col("_c") == F.col("colour_group_name"))) & (F.col("_f").isNull() | (F.col("_f") == section_family(F.col("section_name"))))
    kind, colour, family = _parts()
    scored = both.filter(fits).select("query_id", "article_id", (kind.cast("double") * 2 + colour.cast("double") + family.cast("double")).alias("score"))
    return top_rank(scored, ["query_id"], [F.col("score").desc(), "article_id"], k)


def attribute_score() -> Column:
    kind, colour, family = _parts()
    return kind.cast("double") + colour.cast("double") * 0.6 + family.cast("double") * 0.4


def passes_hard() -> Column:
    """Type and section as named; the colour too where a type is named."""
    kind, colour, family = _parts()
    return (F.col("product_type").isNull() | kind) & (~F.col("hard_color") | colour) & (F.col("section").isNull() | family)


# --------------------------------------------------------------------------- vectors


def vector_search(queries: DataFrame, items: DataFrame, k: int = 200) -> DataFrame:
    """Exact best items of each query vector. queries: (query_id, embedding); items: (article_id, embedding, status).

    Items are multiplied in blocks where their matrix is small enough to be sent to all tasks, and joined otherwise.
    """
    found = exact_neighbours(queries, items.filter("status = 1"), k, "query_id")
    return found.select("query_id", "article_id", F.col("source_score").alias("score"), F.col("source_rank").alias("rank"))


# --------------------------------------------------------------------------- fusion


def fuse(intents: DataFrame, articles: DataFrame, channels: Mapping[str, DataFrame], personal: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """Weighted sum of channels scaled by their best, reciprocal ranks of bm25 and semantic, attributes and preference; hard filters.

    channels: name to (query_id, article_id, score, rank). personal: (query_id, article_id, score).
    """
    long = None
    for name in WEIGHTS:
        if name in channels:
            part = channels[name].select("query_id", "article_id", F.lit(name).alias("channel"), "score", "rank")
            long = part if long is None else long.unionByName(part)
    best = F.max("score").over(Window.partitionBy("query_id", "channel"))
    scaled = long.withColumn("_s", F.when(best > 0, F.col("score") / best).otherwise(0.0))
    wide = scaled.groupBy("query_id", "article_id").pivot("channel", list(WEIGHTS)).agg(F.max("_s").alias("s"), F.min("rank").alias("r"))
    all_ = wide.join(intents, "query_id").join(articles.select("article_id", "product_type_name", "colour_group_name", "section_name").hint("merge"), "article_id").filter(passes_hard())
    value = sum((F.coalesce(F.col(f"{n}_s"), F.lit(0.0)) * w for n, w in WEIGHTS.items()), F.lit(0.0)) + attribute_score() * ATTRIBUTES
    for n in ("bm25", "semantic"):
        value = value + rrf(F.coalesce(F.col(f"{n}_r"), F.lit(UNRANKED)))
    out = all_.select("query_id", "article_id", value.alias("query_relevance"), F.array_join(F.array_compact(F.array(*[F.when(F.col(f"{n}_r").isNotNull(), F.lit(n)) for n in WEIGHTS])), ",").alias("sources"))
    if personal is not None:
        top = F.max("score").over(Window.partitionBy("query_id"))
        p = personal.select("query_id", "article_id", F.when(top > 0, F.col("score") / top).otherwise(0.0).alias("_p"))
        out = out.join(p, ["query_id", "article_id"], "left").withColumn("personalization", F.coalesce("_p", F.lit(0.0)) * PERSONAL).drop("_p")
    else:
        out = out.withColumn("personalization", F.lit(0.0))
    out = out.withColumn("score", F.col("query_relevance") + F.col("personalization"))
    return top_rank(out, ["query_id"], [ranked9(F.col("score")).desc(), "article_id"], limit)


def external_order(results: DataFrame, external: DataFrame) -> DataFrame:
    """Results reordered by an external list (query_id, article_id, position): its valid articles first, then the rest as they were."""
    order = external.groupBy("query_id", "article_id").agg(F.min("position").alias("_e"))
    w = Window.partitionBy("query_id").orderBy(F.col("_e").asc_nulls_last(), "rank")
    return results.join(order, ["query_id", "article_id"], "left").withColumn("rank", F.row_number().over(w).cast("long")).drop("_e")


def personal_rerank(results: DataFrame, personal: DataFrame, limit: int, ordered: bool = False) -> DataFrame:
    """Preference added on top of relevance, or of place (1 - i / n) where an external order stands."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    p = personal.select("query_id", "article_id", F.when(top > 0, F.col("score") / top).otherwise(0.0).alias("_p"))
    w = Window.partitionBy("query_id")
    base = 1.0 - (F.col("rank") - 1) / F.count(F.lit(1)).over(w) if ordered else F.col("query_relevance")
    r = results.join(p, ["query_id", "article_id"], "left").withColumn("personal_score", base + F.coalesce("_p", F.lit(0.0)) * PERSONAL)
    return r.withColumn("new_rank", F.row_number().over(w.orderBy(ranked9(F.col("personal_score")).desc(), "rank", "article_id")).cast("long")).filter(F.col("new_rank") <= limit).drop("_p")


# --------------------------------------------------------------------------- evaluation


def structured_queries(articles: DataFrame, at_least: int = 40, most: int = 80) -> DataFrame:
    """Colour and type pairs that many articles share, as query texts, the most frequent first."""
    n = articles.filter("colour_group_name <> '' AND product_type_name <> ''").groupBy("colour_group_name", "product_type_name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)
    top = n.orderBy(F.col("n").desc(), "colour_group_name", "product_type_name").limit(most)
    w = Window.orderBy(F.col("n").desc(), "colour_group_name", "product_type_name")  # at most ``most`` lines
    return top.select(F.row_number().over(w).cast("long").alias("query_id"), F.lower(F.concat_ws(" ", "colour_group_name", "product_type_name")).alias("text"), "n")


def style_relevance(text: Column, style_terms: Column) -> Column:
    """How many of the wanted styles the text contains."""
    wanted = F.filter(F.split(style_terms, " "), lambda t: t != "")
    return F.size(F.filter(wanted, lambda t: F.contains(F.lower(text), t)))


def structured_relevance() -> Column:
    kind, colour, family = _parts()
    return kind.cast("int") * 2 + colour.cast("int") + family.cast("int")


def weak_label() -> Column:
    """0 to 4 from attributes alone."""
    return F.least(structured_relevance(), F.lit(4))


def pair_features(fused_channels: DataFrame) -> DataFrame:
    """What a learned ranker sees of a query and an article, from (bm25, semantic, structured, bm25_rank, semantic_rank) and the intent's columns."""
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    kind, colour, family = _parts()
    return fused_channels.select(
        "query_id", "article_id", z("bm25").alias("f_bm25"), z("semantic").alias("f_semantic"), z("structured").alias("f_structured"), attribute_score().alias("f_attributes"),
        kind.cast("double").alias("f_type"), colour.cast("double").alias("f_colour"), family.cast("double").alias("f_section"), F.size("tokens").cast("double").alias("f_query_length"),
    )


def win_tie_loss(per_query: DataFrame, base: str, arm: str) -> DataFrame:
    d = F.col(arm) - F.col(base)
    return per_query.agg(F.avg(base).alias("base_mean"), F.avg(arm).alias("arm_mean"), F.count_if(d > 1e-12).alias("wins"), F.count_if(F.abs(d) <= 1e-12).alias("ties"), F.count_if(d < -1e-12).alias("losses"))


def pooled_candidates(*results: DataFrame, depth: int = 10) -> DataFrame:
    """The union of several rankings' first places, by best rank, then article."""
    long = results[0].select("query_id", "article_id", "rank")
    for r in results[1:]:
        long = long.unionByName(r.select("query_id", "article_id", "rank"))
    best = long.filter(F.col("rank") <= depth).groupBy("query_id", "article_id").agg(F.min("rank").alias("best_rank"))
    return top_rank(best, ["query_id"], ["best_rank", "article_id"], None, "position")


def validate_judgements(judged: DataFrame, expected: DataFrame) -> list[str]:
    """What is wrong with a judged set: missing or unknown candidates, repeats, grades outside 0 to 3."""
    a, b = judged.select("query_id", "article_id"), expected.select("query_id", "article_id")
    found = {
        "missing": b.subtract(a), "unknown": a.subtract(b), "repeated": a.groupBy("query_id", "article_id").count().filter("count > 1"),
        "grade": judged.filter("relevance IS NULL OR relevance NOT BETWEEN 0 AND 3"),
    }
    return [name for name, rows in found.items() if rows.limit(1).count()]


def frozen_rankings(query: str, row: Mapping[str, object], variants: Sequence[str]) -> tuple[dict[str, list[str]], set[str]]:
    """A query's stored rankings by variant, and all their articles; raises where variants or identifiers are not as they should be."""
    held = row.get("rankings")
    faults = []
    if not isinstance(held, dict) or held.keys() != set(variants):
        raise ValueError(f"{query!r}: the rankings must be those of {', '.join(variants)}")
    for name, listed in held.items():
        if not isinstance(listed, list) or not all(isinstance(x, str) for x in listed):
            faults.append(f"{name} is no list of identifiers")
        elif len(set(listed)) < len(listed):
            faults.append(f"{name} names an article twice")
    if faults:
        raise ValueError(f"{query!r}: {'; '.join(faults)}")
    return {name: list(held[name]) for name in variants}, set().union(*held.values())


class SearchEngine:
    """Intent, retrieval, fusion, optional external steps, preference: one call for a relation of queries."""

    def __init__(self, articles: DataFrame, text: Column, aliases: DataFrame, semantic: Callable[[DataFrame], DataFrame] | None = None, visual: Callable[[DataFrame], DataFrame] | None = None, reorder: Callable[[DataFrame], DataFrame] | None = None):
        """semantic, visual: intents to (query_id, embedding) joined with items elsewhere, giving ranked results. reorder: results to an external order."""
        self.articles, self.text, self.aliases, self.semantic, self.visual, self.reorder = articles, text, aliases, semantic, visual, reorder

    def search(self, queries: DataFrame, limit: int = 20, personal: DataFrame | None = None) -> DataFrame:
        intents = parse_intent(queries, self.aliases)
        lexical = intents.select("query_id", F.col("semantic_query").alias("text"))
        channels = {"bm25": bm25_search(lexical, self.articles, "article_id", self.text).withColumnRenamed("doc", "article_id"), "structured": structured_search(intents, self.articles)}
        for name, channel in (("semantic", self.semantic), ("visual", self.visual)):
            if channel:
                channels[name] = channel(intents)
        if not self.reorder:
            return fuse(intents, self.articles, channels, personal, limit)
        results = external_order(out := fuse(intents, self.articles, channels, None, limit), self.reorder(out))
        return personal_rerank(results, personal, limit, ordered=True) if personal is not None else results


def build_search_engine(articles: DataFrame, text: Column, aliases: DataFrame, pictures: DataFrame | None = None, reorder: Callable[[DataFrame], DataFrame] | None = None) -> SearchEngine:
    """An engine whose semantic channel compares texts (``TextIndex``) and whose visual one, where there are pictures, looks for what the
    articles found by text look like."""
    index = TextIndex(articles, text)

    def visual(intents: DataFrame) -> DataFrame:
        return vector_search(as_vectors(picture_query(index.search(intents, "semantic_query"), pictures), "query_id"), pictures)

    return SearchEngine(articles, text, aliases, lambda intents: index.search(intents, "semantic_query"), visual if pictures is not None else None, reorder)
