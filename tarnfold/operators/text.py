"""Keyword labelling, label matching and dictionary translation as column expressions.

A dictionary or label list reaches the rows as one value, so that labelling a text is a
projection: no join, no shuffle, whatever language dominates the table. Long dictionaries are cut
into pieces of bounded size and their results combined. A few keywords are tried one by one; of
more than that an inverted index is made, in which every keyword stands under its rarest fragment, and
only those whose fragment is in the text are tried.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarnfold.functions.columns import hash_number
from tarnfold.functions.vocabulary import PREFIXES, STEM_RULES, STOP_WORDS, TRANSLATIONS
from tarnfold.operators.encode import union_rows
from tarnfold.operators.joins import measured
from tarnfold.operators.windows import seeded_sample, top_k_per_key

PIECE_ROWS = 50_000
# Dictionary rows up to which every keyword is tried on every text.
FEW_KEYWORDS = 200
# Characters of the fragments that keywords are found by; shorter keywords are their own fragment.
FRAGMENT = 4
ANY_LANGUAGE = "*"
WORD = r"(?<![\p{L}\p{N}_])[a-z]{3,}(?![\p{L}\p{N}_])"
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def dictionary_frame(
    spark: SparkSession, dictionary: Mapping[str, Mapping[str, Sequence[str]]]
) -> DataFrame:
    """``{label: {lang: [keyword, ...]}}`` as rows ``(label, lang, keyword)``."""
    rows = [(lb, lg, kw) for lb, by in dictionary.items() for lg, kws in by.items() for kw in kws]
    return spark.createDataFrame(rows, "label string, lang string, keyword string")


def weighted_dictionary(
    dictionary: DataFrame, own: float = 2.0, english: float = 1.0
) -> DataFrame:
    """Rows ``(lang, label, keyword, weight)``: own-language keywords, then the English
    ones again for every language (English texts thus get both), and for unknown ones."""
    langs = dictionary.select("lang").distinct().agg(
        F.array_append(F.collect_set("lang"), F.lit(ANY_LANGUAGE)).alias("all")
    )
    mine = dictionary.select("lang", "label", "keyword", F.lit(own).alias("weight"))
    shared = dictionary.filter(F.col("lang") == "en").select(
        F.explode(langs.scalar()).alias("lang"), "label", "keyword", F.lit(english).alias("weight")
    )
    return mine.unionByName(shared)


def unit_dictionary(words: DataFrame) -> DataFrame:
    """Learned ``(label, word)`` rows as a dictionary that ignores the language."""
    return words.select(
        F.lit(ANY_LANGUAGE).alias("lang"), "label", F.col("word").alias("keyword"), F.lit(1.0).alias("weight")
    )


def _pieces(df: DataFrame, by: str) -> list[DataFrame]:
    stored, rows = measured(df)
    n = max(1, math.ceil(rows / PIECE_ROWS))
    if n == 1:
        return [stored]
    return [stored.filter(F.pmod(F.xxhash64(by), F.lit(n)) == i) for i in range(n)]


def _by_language(piece: DataFrame) -> Column:
    entries = piece.groupBy("lang", "label").agg(
        F.collect_list(F.struct("keyword", "weight")).alias("words")
    )
    table = entries.groupBy("lang").agg(F.collect_list(F.struct("label", "words")).alias("entries"))
    return table.agg(F.map_from_entries(F.collect_list(F.struct("lang", "entries"))).alias("m")).scalar()


def _scores(table: Column, lang: Column, text: Column) -> Column:
    entries = F.coalesce(F.try_element_at(table, lang), F.try_element_at(table, F.lit(ANY_LANGUAGE)))

    def score(entry: Column) -> Column:
        return F.aggregate(
            entry["words"],
            F.lit(0.0),
            lambda total, w: total + F.when(F.contains(text, w["keyword"]), w["weight"]).otherwise(F.lit(0.0)),
        )

    return F.transform(entries, lambda e: F.struct((-score(e)).alias("minus"), e["label"].alias("label")))


def _grams(text: str, n: int) -> set[str]:
    return {text[i : i + n] for i in range(len(text) - n + 1)}


class KeywordIndex:
    """Keywords of one language under their rarest fragments: (label, keyword, weight) rows."""

    def __init__(self, rows: Iterable[tuple[str, str, float]]):
        rows = [r for r in rows if r[1] is not None]
        own = {k: _grams(k, min(FRAGMENT, len(k))) for _, k, _ in rows}
        met = Counter(g for _, k, _ in rows for g in own[k])
        self.under: dict[str, list[tuple[str, str, float]]] = defaultdict(list)
        for row in rows:
            self.under[min(own[row[1]], key=lambda g: (met[g], -len(g), g))].append(row)
        self.sizes = sorted({len(g) for g in self.under})

    def scores(self, text: str) -> dict[str, float]:
        """Summed weights of each label with a keyword in the text."""
        out: dict[str, float] = {}
        for n in self.sizes:
            for fragment in _grams(text, n) & self.under.keys():
                for label, keyword, weight in self.under[fragment]:
                    if keyword in text:
                        out[label] = out.get(label, 0.0) + weight
        return out


def _indexed(piece: DataFrame, lang: Column, text: Column) -> Column:
    """As :func:`_scores`, for labels with a hit only; the piece (bounded by PIECE_ROWS) goes out as a broadcast."""
    rows = defaultdict(list)
    for r in piece.select("lang", "label", "keyword", "weight").toLocalIterator():
        rows[r.lang].append((r.label, r.keyword, float(r.weight)))
    sent = piece.sparkSession.sparkContext.broadcast({code: KeywordIndex(some) for code, some in rows.items()})

    @F.arrow_udf("array<struct<minus: double, label: string>>")
    def scores(langs: pa.Array, texts: pa.Array) -> pa.Array:
        indexes, out = sent.value, []
        for code, body in zip(langs.to_pylist(), texts.to_pylist()):
            index = indexes.get(code, indexes.get(ANY_LANGUAGE)) if code is not None else indexes.get(ANY_LANGUAGE)
            hits = index.scores(body) if index is not None and body is not None else {}
            out.append([{"minus": -score, "label": label} for label, score in hits.items()])
        return pa.array(out, pa.list_(pa.struct([("minus", pa.float64()), ("label", pa.string())])))

    return scores(lang, text)


def _scored(df: DataFrame, dictionary: DataFrame, text: str, lang: str | None) -> tuple[DataFrame, list[str]]:
    pieces = _pieces(dictionary, "label")
    names = [f"_scores{i}" for i in range(len(pieces))]
    language = F.col(lang) if lang else F.lit(ANY_LANGUAGE)
    lowered = df.withColumn("_text", F.lower(text))
    few = len(pieces) == 1 and pieces[0].count() <= FEW_KEYWORDS
    for name, piece in zip(names, pieces):
        if few:
            lowered = lowered.withColumn(f"_table{name}", _by_language(piece))
            lowered = lowered.withColumn(name, _scores(F.col(f"_table{name}"), language, F.col("_text")))
        else:
            lowered = lowered.withColumn(name, _indexed(piece, language, F.col("_text")))
    return lowered.drop(*[f"_table{n}" for n in names]), names


def keyword_scores(
    df: DataFrame, dictionary: DataFrame, key: str = "id", text: str = "text", lang: str | None = "lang"
) -> DataFrame:
    """``(key, label, score)`` for every label with at least one keyword in the text."""
    scored, names = _scored(df, dictionary, text, lang)
    hits = F.flatten(F.array(*[F.coalesce(F.col(n), F.array()) for n in names]))
    return (
        scored.select(key, F.inline(hits))
        .filter(F.col("minus") < 0)
        .select(key, "label", (-F.col("minus")).alias("score"))
    )


def keyword_classify(
    df: DataFrame,
    dictionary: DataFrame,
    text: str = "text",
    lang: str | None = "lang",
    out: str = "label",
    score: str = "score",
) -> DataFrame:
    """Best label, the first in sort order on ties; NULL and 0 when no keyword occurs."""
    scored, names = _scored(df, dictionary, text, lang)
    best = F.array_min(F.array_compact(F.array(*[F.array_min(F.col(n)) for n in names])))
    return scored.withColumn("_best", best).select(
        *df.columns,
        F.when(F.col("_best.minus") < 0, F.col("_best.label")).alias(out),
        F.when(F.col("_best.minus") < 0, -F.col("_best.minus")).otherwise(F.lit(0.0)).alias(score),
    )


def learn_keywords(
    df: DataFrame, k: int = 20, text: str = "text", label: str = "label", stop: Sequence[str] = STOP_WORDS
) -> DataFrame:
    """The ``k`` most frequent words of every label: ``(label, word, n, rank)``."""
    words = df.select(
        F.col(label).alias("label"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("word")
    ).filter(~F.col("word").isin(list(stop)))
    counts = words.groupBy("label", "word").agg(F.count("*").alias("n"))
    return top_k_per_key(counts, ["label"], [F.desc("n"), F.col("word")], k)


def _label_arrays(labels: DataFrame) -> list[Column]:
    distinct = labels.select(F.col(labels.columns[0]).alias("label")).filter(F.col("label").isNotNull()).distinct()
    return [p.agg(F.array_sort(F.collect_set("label")).alias("l")).scalar() for p in _pieces(distinct, "label")]


def _with_labels(df: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str]]:
    arrays = _label_arrays(labels)
    names = [f"_labels{i}" for i in range(len(arrays))]
    return df.withColumns(dict(zip(names, arrays))), names


def _first(names: Sequence[str], condition: Callable[[Column], Column] | None = None) -> Column:
    """First label in sort order that meets the condition."""
    found = [F.array_min(F.filter(n, condition)) if condition else F.array_min(n) for n in names]
    return found[0] if len(found) == 1 else F.array_min(F.array_compact(F.array(*found)))


def pattern_fallback(
    df: DataFrame,
    labels: DataFrame,
    text: str = "text",
    out: str = "label",
    rules: Mapping[str, Sequence[str]] = STEM_RULES,
) -> DataFrame:
    """First rule with a stem in the text and a label containing its key; else the first label."""
    wide, names = _with_labels(df.withColumn("_text", F.lower(text)), labels)

    def named_after(key: str) -> Callable[[Column], Column]:
        return lambda label: F.contains(F.lower(label), F.lit(key))

    choices = []
    for key, stems in rules.items():
        hit = F.lit(False)
        for stem in stems:
            hit = hit | F.contains(F.col("_text"), F.lit(stem))
        choices.append(F.when(hit, _first(names, named_after(key))))
    return wide.withColumn("_out", F.coalesce(*choices, _first(names))).select(
        *df.columns, F.col("_out").alias(out)
    )


def match_label(
    df: DataFrame,
    labels: DataFrame,
    response: str = "response",
    mode: str = "partial",
    out: str = "label",
) -> DataFrame:
    """Free text to a label: exact, then substring either way, then (``overlap``) most
    shared ``_`` parts, then the first label."""
    if mode not in ("partial", "overlap"):
        raise ValueError("mode is 'partial' or 'overlap'")
    clean = F.regexp_replace(F.lower(F.regexp_replace(F.col(response), r"(?U)^\s+|\s+$", "")), "[ -]", "_")
    wide, names = _with_labels(df.withColumn("_r", clean), labels)
    r = F.col("_r")
    steps = [
        _first(names, lambda lb: F.lower(lb) == r),
        _first(names, lambda lb: F.contains(F.lower(lb), r) | F.contains(r, F.lower(lb))),
    ]
    if mode == "overlap":
        parts = F.array_distinct(F.split(r, "_"))

        def shared(lb: Column) -> Column:
            common = F.array_intersect(F.split(F.lower(lb), "_"), parts)
            return F.struct((-F.size(common)).alias("minus"), lb.alias("label"))

        best = F.array_min(
            F.array_compact(F.array(*[F.array_min(F.transform(n, shared)) for n in names]))
        )
        wide = wide.withColumn("_best", best)
        steps.append(F.when(F.col("_best.minus") < 0, F.col("_best.label")))
    return wide.withColumn("_out", F.coalesce(*steps, _first(names))).select(
        *df.columns, F.col("_out").alias(out)
    )


def dictionary_translate(
    text: str | Column, lang: str, table: Mapping[str, Mapping[str, str]] = TRANSLATIONS
) -> Column:
    """Word by word, lower-cased; unknown words stay. The characters of a known word past
    the length of its letters follow the translation, wherever the punctuation stood."""
    source = F.col(text) if isinstance(text, str) else text
    known = F.create_map(
        *[F.lit(x) for word, to in table.items() if lang in to for x in (word, to[lang])]
    )
    words = F.filter(F.split(F.lower(source), BLANKS), lambda w: w != "")

    def translated(word: Column) -> Column:
        letters = F.regexp_replace(word, r"[^\p{L}\p{N}_]", "")
        target = F.try_element_at(known, letters)
        return F.coalesce(F.concat(target, F.substr(word, F.length(letters) + 1)), word)

    return F.array_join(F.transform(words, translated), " ")


def random_prefix(
    text: str | Column,
    key: str,
    lang: str,
    seed: int = 42,
    percent: int = 30,
    prefixes: Mapping[str, Sequence[str]] = PREFIXES,
) -> Column:
    """Put a phrase before the given share of texts, both drawn from the row key's hash."""
    source = F.col(text) if isinstance(text, str) else text
    draw = hash_number(key, seed)
    choices = F.array(*[F.lit(p) for p in prefixes[lang]])
    pick = F.pmod(F.floor(draw / 100), F.lit(len(prefixes[lang]))).cast("int")
    return F.when(
        F.pmod(draw, F.lit(100)) < percent, F.concat(F.get(choices, pick), F.lit(": "), source)
    ).otherwise(source)


def augment(
    df: DataFrame,
    fraction: float = 0.5,
    key: str = "id",
    text: str = "text",
    lang: str = "lang",
    targets: Sequence[str] = ("de", "fr"),
    seed: int = 42,
) -> DataFrame:
    """The table plus one translated copy per target language of a seeded sample."""
    chosen = seeded_sample(df, fraction=fraction, key=key, seed=seed)
    copies = [
        chosen.withColumns(
            {text: random_prefix(dictionary_translate(text, t), key, t, seed), lang: F.lit(t)}
        )
        for t in targets
    ]
    return union_rows(df, *copies)


def route_by_language(
    df: DataFrame,
    mappers: Mapping[str, Callable[[Column], Column]],
    text: str = "text",
    lang: str = "lang",
    out: str = "routed",
) -> DataFrame:
    """Apply a text mapping (a column function or pandas UDF) only where the language asks for it.

    A UDF inside a CASE runs on every row, so the rows of each language are filtered first and a mapper gets these
    only. The table is read once for each language and once for the others.
    """
    routed = [df.filter(F.col(lang).eqNullSafe(F.lit(code))).withColumn(out, mapper(F.col(text))) for code, mapper in mappers.items()]
    others = df
    for code in mappers:
        others = others.filter(~F.col(lang).eqNullSafe(F.lit(code)))
    return union_rows(others.withColumn(out, F.col(text)), *routed)


def render_prompt(
    df: DataFrame,
    labels: DataFrame,
    before: str,
    between: str,
    after: str,
    first_labels: int | None = None,
    max_chars: int | None = None,
    text: str = "text",
    lang: str = "lang",
    out: str = "prompt",
) -> DataFrame:
    """``before + label list + language + between + text + after``.

    All labels are listed unless ``first_labels`` asks for the first ones only, and ``max_chars``
    shortens the text for models with a small window; by default it is whole.
    """
    listed = labels.select(F.col(labels.columns[0]).alias("label")).distinct()
    if first_labels is not None:
        listed = listed.orderBy("label").limit(first_labels)
    lines = F.array_join(
        F.transform(F.array_sort(F.collect_list("label")), lambda lb: F.concat(F.lit("- "), lb)), "\n"
    )
    body = F.col(text) if max_chars is None else F.substring(text, 1, max_chars)
    return df.withColumn(
        out,
        F.concat(
            F.lit(before), listed.agg(lines.alias("l")).scalar(), F.lit("\n"), F.col(lang), F.lit(between), body, F.lit(after)
        ),
    )
