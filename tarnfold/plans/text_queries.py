"""Keyword labelling, label matching, translation and prompts over whole texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tarnfold.functions.vocabulary import PREFIXES, STEM_RULES, STOP_WORDS
from tarnfold.operators import text
from tarnfold.operators.ensemble import first_non_null, override_if
from tarnfold.plans.registry import query
from tarnfold.session import spread
from tarnfold.sources.views import documents, table

# Word parts that occur in about a tenth to a third of the texts of a language.
KEYWORDS = {
    "alpha": {"en": ["nation", "resh"], "de": ["einver", "gelich"], "fr": ["ouaux", "queai"], "es": ["queci", "llmi"]},
    "beta": {"en": ["ndble", "edhe"], "de": ["ungver", "stau"], "fr": ["eneau", "vire"], "es": ["jata", "uera"]},
    "gamma": {"en": ["ndly", "haly"], "de": ["ungkeit"], "fr": ["queê"], "es": ["oses"]},
    "delta": {"en": ["zzzz"], "de": ["zzzz"]},
}
# Stand-ins for the built-in word table: words that do occur in the given texts.
WORDS = {
    "that": {"de": "dass", "fr": "que"},
    "with": {"de": "mit", "fr": "avec"},
    "this": {"de": "dies", "fr": "ce"},
    "from": {"de": "von"},
    "und": {"fr": "et"},
    "nicht": {"fr": "pas"},
}
RULES = {"view": ("nation", "zzzz"), "click": ("ndble", "einver"), "sign": ("edhe", "ouaux"), "none": ("the", "que")}


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_ROWS = ", ".join(
    f"({_quote(lb)}, {_quote(lg)}, {_quote(kw)})" for lb, by in KEYWORDS.items() for lg, kws in by.items() for kw in kws
)
SCORES_SQL = f"""kw as (select * from (values {_ROWS}) v(label, lang, keyword)),
 entries as (select label, lang, keyword, 2.0::double as w from kw union all
  select label, l.lang, keyword, 1.0::double from kw cross join (select distinct lang from documents) l where kw.lang = 'en'),
 scores as (select doc_id as id, e.label, sum(w) as score from documents d join entries e on d.lang = e.lang
  and contains(lower(d.text), e.keyword) group by 1, 2)"""
CLASSIFIED_SQL = f"""{SCORES_SQL}, best as (select id, label, score from scores
  qualify row_number() over (partition by id order by score desc, label) = 1)"""


def _dictionary(spark):
    return text.weighted_dictionary(text.dictionary_frame(spark, KEYWORDS))


@query("keyword_scores", f"with {SCORES_SQL} select id, label, score from scores")
def keyword_scores(spark, sf):
    return text.keyword_scores(documents(spark, sf).drop("label"), _dictionary(spark))


@query(
    "keyword_classify",
    f"with {CLASSIFIED_SQL} select doc_id as id, label, coalesce(score, 0.0) as score from documents left join best on id = doc_id",
)
def keyword_classify(spark, sf):
    return text.keyword_classify(documents(spark, sf).drop("label"), _dictionary(spark)).select("id", "label", "score")


@query(
    "keyword_override",
    f"""with {CLASSIFIED_SQL} select doc_id as id, case when score > 3 then label else source end as confident,
 coalesce(label, source) as keyword_first from documents left join best on id = doc_id""",
)
def keyword_override(spark, sf):
    docs = documents(spark, sf).withColumnRenamed("label", "model")
    out = text.keyword_classify(docs, _dictionary(spark))
    return out.select(
        "id",
        override_if("label", "score", "model", 3.0).alias("confident"),
        first_non_null("label", "model").alias("keyword_first"),
    )


_STOP = ", ".join(_quote(w) for w in STOP_WORDS)
LEARNED_SQL = f"""w as (select source as label, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) as word from documents),
 n as (select label, word, count(*) as n from w where regexp_full_match(word, '[a-z]{{3,}}') and word not in ({_STOP}) group by 1, 2),
 learned as (select label, word, n, cast(row_number() over (partition by label order by n desc, word) as integer) as rank from n
  qualify rank <= 20)"""


@query("learn_keywords", f"with {LEARNED_SQL} select label, word, n, rank from learned")
def learn_keywords(spark, sf):
    return text.learn_keywords(documents(spark, sf))


@query(
    "learned_classify",
    f"""with {LEARNED_SQL}, s as (select conv_id, turn, label, count(*) as score from conversations c join learned l on contains(lower(c.text), l.word)
  group by 1, 2, 3), b as (select * from s qualify row_number() over (partition by conv_id, turn order by score desc, label) = 1)
 select conv_id, turn, label, coalesce(cast(score as double), 0.0) as score from conversations left join b using (conv_id, turn)""",
)
def learned_classify(spark, sf):
    words = text.unit_dictionary(text.learn_keywords(documents(spark, sf)))
    talk = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    return text.keyword_classify(talk, words, lang=None).drop("text")


def _rules_sql(rules, labels):
    cases = " ".join(
        f"when ({' or '.join(f'contains(t, {_quote(s)})' for s in stems)})"
        f" and (select min(label) from {labels} where contains(lower(label), {_quote(key)})) is not null"
        f" then (select min(label) from {labels} where contains(lower(label), {_quote(key)}))"
        for key, stems in rules.items()
    )
    return f"case {cases} else (select min(label) from {labels}) end"


_LABELS = "labels_ as (select distinct event_type as label from events)"


@query(
    "pattern_fallback",
    f"""with {_LABELS}, d as (select doc_id as id, lower(text) as t from documents)
 select id, {_rules_sql(RULES, 'labels_')} as label, {_rules_sql(STEM_RULES, 'labels_')} as fixed_rules from d""",
)
def pattern_fallback(spark, sf):
    kinds = table(spark, sf, "events").select("event_type")
    docs = documents(spark, sf).select("id", "text")
    out = text.pattern_fallback(docs, kinds, rules=RULES)
    return text.pattern_fallback(out, kinds, out="fixed_rules").drop("text")


RESPONSES_SQL = """responses as (select event_id, case event_id % 7 when 0 then concat(upper(event_type), ' Now') when 1 then 'sign-up'
  when 2 then '' when 3 then 'click purchase' when 4 then 'unknown thing' when 5 then concat(' ', event_type, ' ')
  else concat('Big-', event_type, '-', user_id % 3) end as response from events)"""
# labels with several parts, so that parts can overlap
_PARTS = """parts as (select distinct concat(event_type, '_', case user_id % 3 when 0 then 'now' when 1 then 'thing' else 'later' end) as label from events)"""
_CLEAN = "replace(replace(lower(trim(response)), ' ', '_'), '-', '_')"


def _responses(spark, sf):
    kind, key = F.col("event_type"), F.col("event_id") % 7
    said = (
        F.when(key == 0, F.concat(F.upper(kind), F.lit(" Now")))
        .when(key == 1, F.lit("sign-up")).when(key == 2, F.lit("")).when(key == 3, F.lit("click purchase"))
        .when(key == 4, F.lit("unknown thing")).when(key == 5, F.concat(F.lit(" "), kind, F.lit(" ")))
        .otherwise(F.concat(F.lit("Big-"), kind, F.lit("-"), (F.col("user_id") % 3).cast("string")))
    )
    return table(spark, sf, "events").select("event_id", said.alias("response"))


@query(
    "match_label",
    f"""with {_LABELS}, {RESPONSES_SQL}, r as (select event_id, {_CLEAN} as r from responses)
 select event_id, coalesce((select min(label) from labels_ where lower(label) = r),
  (select min(label) from labels_ where contains(lower(label), r) or contains(r, lower(label))),
  (select min(label) from labels_)) as label from r""",
)
def match_label(spark, sf):
    kinds = table(spark, sf, "events").select("event_type")
    return text.match_label(_responses(spark, sf), kinds).drop("response")


@query(
    "match_overlap",
    f"""with {_PARTS}, {RESPONSES_SQL}, r as (select event_id, {_CLEAN} as r from responses), u as (select distinct r from r),
 o as (select r, label, len(list_intersect(list_distinct(string_split(lower(label), '_')), list_distinct(string_split(r, '_')))) as n from u, parts),
 b as (select r, label from o where n > 0 qualify row_number() over (partition by r order by n desc, label) = 1),
 m as (select u.r, coalesce((select min(label) from parts where lower(label) = u.r),
  (select min(label) from parts where contains(lower(label), u.r) or contains(u.r, lower(label))), b.label,
  (select min(label) from parts)) as label from u left join b on u.r = b.r)
 select event_id, label from r join m using (r)""",
)
def match_overlap(spark, sf):
    tail = F.when(F.col("user_id") % 3 == 0, F.lit("now")).when(F.col("user_id") % 3 == 1, F.lit("thing")).otherwise(F.lit("later"))
    parts = table(spark, sf, "events").select(F.concat(F.col("event_type"), F.lit("_"), tail).alias("label"))
    return text.match_label(_responses(spark, sf), parts, mode="overlap").drop("response")


def _translate_sql(source, lang):
    table_ = ", ".join(f"{_quote(w)}: {_quote(to[lang])}" for w, to in WORDS.items() if lang in to)
    letters = "regexp_replace(w, '[^\\p{L}\\p{N}_]', '', 'g')"
    known = f"map {{{table_}}}[{letters}]"
    return (
        f"array_to_string(list_transform(list_filter(string_split_regex(lower({source}), '\\s+'), lambda w: w <> ''),"
        f" lambda w: coalesce({known} || substr(w, length({letters}) + 1), w)), ' ')"
    )


@query(
    "dictionary_translate",
    f"select doc_id as id, {_translate_sql('text', 'de')} as de, {_translate_sql('text', 'fr')} as fr from documents",
)
def dictionary_translate(spark, sf):
    return documents(spark, sf).select(
        "id",
        text.dictionary_translate("text", "de", WORDS).alias("de"),
        text.dictionary_translate("text", "fr", WORDS).alias("fr"),
    )


def _prefixed_sql(source, lang):
    number = "cast(concat('0x', substr(md5(concat(cast(doc_id as varchar), ':42')), 1, 8)) as bigint)"
    choices = ", ".join(_quote(p) for p in PREFIXES[lang])
    return f"case when {number} % 100 < 30 then concat([{choices}][({number} // 100) % {len(PREFIXES[lang])} + 1], ': ', {source}) else {source} end"


@query(
    "augment",
    f"""with s as (select * from documents order by md5(concat(cast(doc_id as varchar), ':42')), doc_id
  limit (select cast(floor(count(*) * 0.5::double) as bigint) from documents))
 select doc_id as id, text, lang from documents
 union all select doc_id, {_prefixed_sql("array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''), ' ')", 'de')}, 'de' from s
 union all select doc_id, {_prefixed_sql("array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''), ' ')", 'fr')}, 'fr' from s""",
)
def augment(spark, sf):
    # none of the built-in words occurs in the texts, so the copies differ by case, spacing and prefix
    return text.augment(documents(spark, sf).select("id", "text", "lang"), 0.5)


def _backwards(s: pd.Series) -> pd.Series:
    return s.str[::-1]


@query(
    "route_by_language",
    """select doc_id as id, case lang when 'de' then lower(text) when 'fr' then reverse(text) else text end as routed from documents""",
)
def route_by_language(spark, sf):
    out = text.route_by_language(documents(spark, sf), {"de": F.lower, "fr": F.reverse})
    return out.select("id", "routed")


@query("route_with_udf", "select doc_id as id, case lang when 'de' then reverse(text) else text end as routed from documents")
def route_with_udf(spark, sf):
    return text.route_by_language(documents(spark, sf), {"de": F.pandas_udf(_backwards, "string")}).select("id", "routed")


BEFORE, BETWEEN, AFTER = "Choose one of:\n", "\nText: ", "\nIntent:"


@query(
    "render_prompt",
    f"""with l as (select distinct source from documents),
 j as (select string_agg(concat('- ', source), chr(10) order by source) as j from l)
 select doc_id as id, concat('Choose one of:', chr(10), j, chr(10), lang, chr(10), 'Text: ', text, chr(10), 'Intent:') as prompt from documents, j""",
)
def render_prompt(spark, sf):
    docs = documents(spark, sf)
    return text.render_prompt(docs, docs.select("label"), BEFORE, BETWEEN, AFTER).select("id", "prompt")
