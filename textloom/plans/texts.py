"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from .base import query

LETTERS = " abcdefghijklmnopqrstuvwxyz'"


@query(f"""WITH c AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(trim(text, ' ' || chr(10))), ''), lambda c: c <> '')) AS c, generate_subscripts(list_filter(regexp_split_to_array(lower(trim(text, ' ' || chr(10))), ''), lambda c: c <> ''), 1) AS i FROM benchmark)
SELECT item_id, string_agg(CAST(instr('{LETTERS.replace("'", "''")}', c) - 1 AS VARCHAR), ' ' ORDER BY i) FILTER (WHERE instr('{LETTERS.replace("'", "''")}', c) > 0) AS ids FROM c GROUP BY item_id""")
def char_tokenise(t):
    ids = tx.char_ids(F.col("text"), LETTERS)
    return t("benchmark").select("item_id", F.array_join(F.transform(ids, lambda k: k.cast("string")), " ").alias("ids"))


@query("SELECT doc_id, md5(lower(trim(text, ' ' || chr(10)))) AS digest FROM documents")
def normalise_base(t):
    return t("documents").select("doc_id", F.md5(tx.normalise_base("text")).alias("digest"))


@query("SELECT doc_id, contains(text, '£') OR contains(text, '€') AS currency FROM documents")
def currency_flag(t):
    return t("documents").select("doc_id", tx.has_currency("text").alias("currency"))


def _abbreviations_sql():
    out = "replace(replace(text, ' as ', ' Dr. '), ' it ', ' st. ')"
    for short, spoken in tx.ABBREVIATIONS.items():
        out = f"regexp_replace({out}, '(^|[^\\p{{L}}\\p{{N}}_])(?i:{short})\\.', '\\1{spoken}', 'g')"
    return out


@query(f"SELECT doc_id, md5({_abbreviations_sql()}) AS digest FROM documents")
def abbrev_expand(t):
    seeded = F.replace(F.replace("text", F.lit(" as "), F.lit(" Dr. ")), F.lit(" it "), F.lit(" st. "))
    return t("documents").select("doc_id", F.md5(tx.expand_abbreviations(seeded)).alias("digest"))


def normal_sql(text):
    """normalise_answer() in SQL: neighbouring articles share the mark between them, so twice."""
    out = f"regexp_replace(lower({text}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    for _ in range(2):
        out = f"regexp_replace({out}, '(^|[^\\p{{L}}\\p{{N}}_])(a|an|the)([^\\p{{L}}\\p{{N}}_]|$)', '\\1 \\3', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


# What each abbreviation must become.
@query("""WITH s AS (SELECT short, spoken, row_number() OVER (ORDER BY short) - 1 AS k FROM (VALUES ('ms', 'miss'), ('mrs', 'misess'), ('mr', 'mister'), ('messrs', 'messeurs'),
('dr', 'doctor'), ('drs', 'doctors'), ('st', 'saint'), ('co', 'company'), ('jr', 'junior'), ('sr', 'senior'), ('rev', 'reverend'), ('hon', 'honorable'), ('sgt', 'sergeant'),
('capt', 'captain'), ('maj', 'major'), ('col', 'colonel'), ('lt', 'lieutenant'), ('gen', 'general'), ('prof', 'professor'), ('lb', 'pounds'), ('rep', 'representative'),
('ave', 'avenue'), ('etc', 'et cetera'), ('jan', 'january'), ('feb', 'february'), ('mar', 'march'), ('apr', 'april'), ('jun', 'june'), ('jul', 'july'), ('aug', 'august'),
('sep', 'september'), ('oct', 'october'), ('nov', 'november'), ('dec', 'december'), ('ltd', 'limited'), ('fig', 'figure'), ('figs', 'figures'), ('gent', 'gentlemen'),
('ft', 'fort'), ('esq', 'esquire'), ('prep', 'preperation'), ('bros', 'brothers'), ('ind', 'independent'), ('mme', 'madame'), ('pro', 'professional'), ('vs', 'versus'),
('inc', 'include')) v(short, spoken))
SELECT c_custkey, 'see ' || spoken || ' there, x' || short || '. ' || c_name AS text FROM customer JOIN s ON k = c_custkey % (SELECT count(*) FROM s)""")
def abbrev_full(t):
    short = F.get(F.lit(sorted(tx.ABBREVIATIONS)), (F.col("c_custkey") % len(tx.ABBREVIATIONS)).cast("int"))
    d = t("customer").select("c_custkey", "c_name", short.alias("short"))
    return d.select("c_custkey", tx.expand_abbreviations(F.concat(F.lit("see "), F.initcap("short"), F.lit(". there, x"), "short", F.lit(". "), "c_name")).alias("text"))


@query(f"SELECT doc_id, md5({normal_sql('text')}) AS answer FROM documents")
def normalise_answer(t):
    return t("documents").select("doc_id", F.md5(tx.normalise_answer(F.col("text"))).alias("answer"))


@query(r"""SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || replace(text, chr(10), ' ') || ' ',
'([{-~\[-` -&(-+:-@/])', ' \1 ', 'g'), '([^0-9])([.,])', '\1 \2 ', 'g'), '([.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g'), '\s+', ' ', 'g')) AS tokens FROM benchmark""")
def tokenise_13a(t):
    return t("benchmark").select("item_id", tx.tokenise_13a(F.col("text")).alias("tokens"))


@query(r"""SELECT doc_id, md5(lower(regexp_replace(text, '[!-/:-@\[\]-`{-~]', '', 'g'))) AS digest FROM documents""")
def punct_strip(t):
    return t("documents").select("doc_id", F.md5(tx.strip_punctuation(F.col("text"))).alias("digest"))


_SPACES = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query("SELECT conv_id, turn, " + _SPACES.format(r"regexp_replace(regexp_replace(strip_accents(lower(text)), '([.!?])', ' \1', 'g'), '[^a-zA-Z.!?]+', ' ', 'g')") + " AS text FROM conversations")
def utterance_normalise(t):
    return t("conversations").select("conv_id", "turn", tx.normalise_utterance(F.col("text")).alias("text"))


@query("SELECT doc_id, " + _SPACES.format(r"lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g'))") + " AS text FROM documents")
def clean_en(t):
    return t("documents").select("doc_id", tx.clean_english(F.col("text")).alias("text"))


def _number_sql(x: str) -> str:
    high = f"concat_ws(', ', CASE WHEN {x} >= 1000000 THEN w[CAST({x} // 1000000 AS INT) + 1] || ' million' END, CASE WHEN {x} // 1000 % 1000 > 0 THEN w[CAST({x} // 1000 % 1000 AS INT) + 1] || ' thousand' END)"
    low = f"w[CAST({x} % 1000 AS INT) + 1]"
    return f"CASE WHEN {x} < 1000 THEN {low} WHEN {x} % 1000 = 0 THEN {high} ELSE {high} || CASE WHEN {x} % 1000 < 100 THEN ' and ' ELSE ', ' END || {low} END"


_ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth"


@query(f"""WITH o AS (SELECT string_split('zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen', ' ') AS ones, string_split('- - twenty thirty forty fifty sixty seventy eighty ninety', ' ') AS tens, string_split('{_ORDINALS}', ' ') AS nth),
s AS (SELECT n, CASE WHEN n % 100 < 20 THEN ones[n % 100 + 1] ELSE tens[n % 100 // 10 + 1] || CASE WHEN n % 10 > 0 THEN '-' || ones[n % 10 + 1] ELSE '' END END AS tail, ones, nth FROM o, range(1000) r(n)),
l AS (SELECT list(CASE WHEN n < 100 THEN tail ELSE ones[n // 100 + 1] || ' hundred' || CASE WHEN n % 100 > 0 THEN ' and ' || tail ELSE '' END END ORDER BY n) AS w, any_value(nth) AS nth FROM s),
p AS (SELECT o_orderkey AS k, CAST(floor(round(o_totalprice * 100)) AS BIGINT) AS cents, w, nth FROM orders, l)
SELECT k AS o_orderkey, 'order ' || {_number_sql('k')} || ' costs ' || {_number_sql('(cents // 100)')} || ' dollars and ' || w[cents % 100 + 1] || CASE WHEN CAST(cents // 100 AS VARCHAR) = lpad(CAST(cents % 100 AS VARCHAR), 2, '0') THEN ' cent' ELSE ' cents' END
|| ' at ' || w[k % 12 + 2] || CASE WHEN k % 60 > 0 THEN ' ' || w[k % 60 + 1] ELSE '' END || ' pm on the ' || nth[k % 20 + 1] || ' for ' || {_number_sql('((k % 97 + 1) * 1000 + 250)')} || ' people' AS spoken FROM p""")
def spoken_numbers(t):
    """Keys, prices, times, days and numbers whose thousands stand apart, of all orders."""
    from ..functions.numbers import speak_numbers

    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    written = F.format_string(
        "order %d costs $%d.%02d at %d:%02dpm on the %dth for %d 250 people", k, F.floor(cents / 100), cents % 100, k % 12 + 1, k % 60, k % 20 + 1, k % 97 + 1
    )
    return t("orders").select("o_orderkey", tx.collapse(speak_numbers(written)).alias("spoken"))
