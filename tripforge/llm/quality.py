"""Line-first quality rules in DataFrame functions only.

Every line of a text is judged by punctuation, navigation and boilerplate rules; failing lines are removed, and a
document that loses more than ``max_lost_percent`` of its characters (counted over lines with a word) is rejected.
Base rules (too few words, too many repeated 5-word windows) reject as well.

Capitals and small letters are those of any script (Unicode's Lu and Ll). Boilerplate phrases are looked for in lines whose
Latin, Greek and Cyrillic capitals, accented ones included, are made small one by one.

Defined results: a null text has no words, no lines and fails the base rules; an empty text likewise; an empty table gives
an empty result. Each row is judged on its own, so repeated rows and null ids need no care. ``judge_lines`` adds one struct;
a column that has its name is replaced, all others stay. A long text is judged whole in one row's expressions, which hold
its words and lines as arrays. Equality of 5-word windows is by 64-bit hash within one text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_table, split_words

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
#: Capitals with one small letter each, up to the end of Cyrillic, and those letters.
UPPER = "".join(chr(c) for c in range(0x41, 0x530) if len(chr(c).lower()) == 1 and chr(c).lower() != chr(c))
LOWER = UPPER.lower().replace("ς", "σ")
#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = [
    "all rights reserved", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookie policy", "cookie settings", "accept cookies", "accept all cookies", "we use cookies", "uses cookies to",
    "enable javascript", "javascript is disabled", "your browser does not support", "click here to", "sign up for our", "sign in to", "log in to", "subscribe to our", "follow us on", "share this", "read more", "back to top",
    "skip to content", "page not found", "powered by", "licensed under", "copyright ©", "© copyright", "unsubscribe", "add to cart", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "allgemeine geschäftsbedingungen", "diese website verwendet cookies", "wir verwenden cookies", "newsletter abonnieren", "weiterlesen", "mehr erfahren",
    "tous droits réservés", "politique de confidentialité", "conditions générales", "mentions légales", "ce site utilise des cookies", "abonnez-vous à", "lire la suite", "en savoir plus",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "términos y condiciones", "aviso legal", "utilizamos cookies", "suscríbete a", "leer más", "sigue leyendo",
    "tutti i diritti riservati", "informativa sulla privacy", "todos os direitos reservados", "política de privacidade", "alle rechten voorbehouden", "все права защищены", "политика конфиденциальности",
]
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT, BOILERPLATE_WORDS, CRUMB_WORDS, UNPUNCTUATED_WORDS = 10, 20, 70, 25, 3, 20


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_fails(line: Column) -> Column:
    """True for a line that a punctuation, navigation or boilerplate rule removes; lines without a word never fail."""

    def rules(n: Column) -> Column:
        has = lambda pattern: F.regexp_like(line, F.lit(pattern))
        often = lambda chars, share: let(_count(line, chars), lambda c: (c >= 3) & (c * 10 >= n * share))
        # characters are counted only in lines where a look at the line leaves the outcome open
        decorated = has(f"[{SYMBOLS}!?]") & (often(SYMBOLS, 3) | often("!?", 3))
        menu = has(f"[{SEPARATORS}]") & let(_count(line, SEPARATORS), lambda c: (c >= 3) & (c * 3 >= n))
        # more than twice as many capitals: two of them stand without a small letter between them, or there is none
        capitals = has(r"\p{Lu}\P{Ll}*\p{Lu}") | ~has(r"\p{Ll}")
        shouted = (n >= 4) & capitals & (F.regexp_count(line, F.lit(r"\p{Lu}")) > 2 * F.regexp_count(line, F.lit(r"\p{Ll}")))
        crumb = (n <= CRUMB_WORDS) & ~has(r"[.!?:;,\"”»…)。！？]\s*$")
        keywords = (n >= UNPUNCTUATED_WORDS) & ~has(r"\p{P}")

        def boiler(low: Column) -> Column:
            return reduce(Column.__or__, [low.contains(phrase) for phrase in BOILERPLATE])

        return (n > 0) & (decorated | shouted | menu | crumb | keywords | ((n <= BOILERPLATE_WORDS) & let(F.translate(line, UPPER, LOWER), boiler)))

    return let(F.size(split_words(line)), rules)


def _window_hashes(words: Column, size: int) -> Column:
    """A hash of every window of ``size`` words, folded from hashes of the words, so that no word is read more than once."""

    def fold(each: Column) -> Column:
        out = each
        for k in range(1, size):
            out = F.zip_with(out, F.slice(each, k + 1, F.size(each) + 1), lambda a, b: F.xxhash64(a, b))
        return F.slice(out, 1, F.greatest(F.size(each) - size + 1, F.lit(0)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), fold)


def repeated_window_words(words: Column, size: int = 5) -> Column:
    """Words that lie in windows of ``size`` words found twice or more in the text, first ones included."""

    def covered(hashes: Column) -> Column:
        def with_repeats(ranked: Column) -> Column:
            again = F.filter(ranked, lambda e, k: F.coalesce((F.get(ranked, k - 1)["h"] == e["h"]), F.lit(False)) | F.coalesce((F.get(ranked, k + 1)["h"] == e["h"]), F.lit(False)))
            return let(
                F.sort_array(F.transform(again, lambda e: e["at"])),
                lambda at: F.aggregate(F.transform(at, lambda p, k: F.coalesce(F.least(F.get(at, k + 1) - p, F.lit(size)), F.lit(size))), F.lit(0), lambda a, x: a + x),
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at")))), with_repeats)
        )

    return F.when(F.size(words) < size + 1, F.lit(0)).otherwise(
        let(_window_hashes(words, size), covered)
    )


def judge_lines(docs: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """Add a struct with the base figures, the cleaned text and the verdict."""
    body = F.coalesce(F.col(text), F.lit(""))

    def figures(words: Column, lines: Column) -> Column:
        spoken = F.filter(lines, lambda x: x["n"] > 0)
        total = F.aggregate(lines, F.lit(0), lambda a, x: a + F.when(x["n"] > 0, F.length(x["line"])).otherwise(0))
        lost = F.aggregate(lines, F.lit(0), lambda a, x: a + F.when(x["fails"], F.length(x["line"])).otherwise(0))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.when(F.regexp_like(body, F.lit(f"[{SYMBOLS}]")), _count(body, SYMBOLS)).otherwise(0).cast("long").alias("n_symbols"),
            (F.size(spoken) - F.size(F.array_distinct(F.transform(spoken, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
            repeated_window_words(words).cast("long").alias("n_repeat_words"),
            total.cast("long").alias("line_chars"),
            lost.cast("long").alias("lost_chars"),
            F.size(F.filter(lines, lambda x: x["fails"])).cast("long").alias("n_lines_removed"),
            F.array_join(F.transform(F.filter(lines, lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("clean_text"),
        )

    def verdict(q: Column) -> Column:
        failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
        gutted = 100 * q["lost_chars"] > MAX_LOST_PERCENT * q["line_chars"]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "lost_chars", "n_lines_removed", "clean_text"]
        return F.struct(*[q[n].alias(n) for n in names], failed.alias("base_failed"), (~failed & ~gutted).alias("kept"))

    lines = F.transform(F.split(body, "\n"), lambda x: F.struct(x.alias("line"), F.size(split_words(x)).alias("n"), line_fails(x).alias("fails")))
    judged = let(let(split_words(body), lambda w: let(lines, lambda x: figures(w, x))), verdict)
    # a generator of one row: a filter on the verdict stays above it, so that a text is judged once
    return docs.drop(into).select("*", F.explode(F.array(judged)).alias(into))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict for every document."""
    judged = judge_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "lost_chars"]
    return judged.select("doc_id", *[F.col("quality")[n].alias(n) for n in names])


def _sql_quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_count(column: str, chars: str) -> str:
    return f"(length({column}) - length(translate({column}, {_sql_quote(chars)}, '')))"


_SQL_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_SQL_BOILER = " or ".join(f"contains(low, {_sql_quote(p)})" for p in BOILERPLATE)
SQL = f"""
with d as (select doc_id, coalesce(text, '') as body, row_number() over () as rid from documents),
w as (select rid, doc_id, body, {_SQL_WORDS.format("body")} as ws from d),
lines as (
  select rid, line, idx, len({_SQL_WORDS.format("line")}) as n, translate(line, '{UPPER}', '{LOWER}') as low
  from (select rid, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as idx from d)),
judged as (
  select *, n > 0 and (
    ({_sql_count("line", SYMBOLS)} >= 3 and {_sql_count("line", SYMBOLS)} * 10 >= n * 3)
    or ({_sql_count("line", "!?")} >= 3 and {_sql_count("line", "!?")} * 10 >= n * 3)
    or (n >= 4 and length(regexp_replace(line, '[^\\p{{Lu}}]', '', 'g')) > 2 * length(regexp_replace(line, '[^\\p{{Ll}}]', '', 'g')))
    or (n >= {UNPUNCTUATED_WORDS} and not regexp_matches(line, '\\p{{P}}'))
    or ({_sql_count("line", SEPARATORS)} >= 3 and {_sql_count("line", SEPARATORS)} * 3 >= n)
    or (n <= {CRUMB_WORDS} and not regexp_matches(line, '[.!?:;,"”»…)。！？]\\s*$'))
    or (n <= {BOILERPLATE_WORDS} and ({_SQL_BOILER}))) as fails
  from lines),
by_line as (
  select rid, count(*) filter (where n > 0) - count(distinct line) filter (where n > 0) as n_dup_lines,
    count(*) filter (where fails) as n_lines_removed,
    coalesce(sum(length(line)) filter (where fails), 0) as lost_chars, coalesce(sum(length(line)) filter (where n > 0), 0) as line_chars
  from judged group by rid),
win as (select rid, i, list_slice(ws, i, i + 4) as win from w, lateral (select unnest(generate_series(1, len(ws) - 4)) as i)),
again as (select rid, i, lead(i) over (partition by rid order by i) as nxt
  from (select rid, i, count(*) over (partition by rid, win) as c from win) where c > 1),
rep as (select rid, sum(least(5, coalesce(nxt - i, 5))) as n_repeat_words from again group by rid),
f as (
  select w.doc_id, len(ws) as n_words, length(translate(body, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as word_chars,
    {_sql_count("body", SYMBOLS)} as n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, n_lines_removed, lost_chars, line_chars,
    len(ws) < {MIN_WORDS} or 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * len(ws) as base_failed
  from w join by_line using (rid) left join rep using (rid))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and not (100 * lost_chars > {MAX_LOST_PERCENT} * line_chars) as kept,
  n_lines_removed::bigint as n_lines_removed, lost_chars::bigint as lost_chars
from f
"""
