"""Text expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A small English stop list.
STOP = "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which will with you".split()
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def clean_text(c: Column) -> Column:
    """STR1: lower-case, everything but ASCII letters to single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", " "))


def tokens(c: Column) -> Column:
    """STR7: ASCII words of the cleaned text; none for null."""
    return F.filter(F.split(clean_text(F.coalesce(c, F.lit(""))), " "), lambda w: w != "")


def terms(c: Column) -> Column:
    """STR8: tokens of two letters or more that aren't stop words."""
    return F.filter(tokens(c), lambda w: (F.length(w) > 1) & ~w.isin(*STOP))


def ngrams(c: Column, n: int = 2) -> Column:
    """STR10, STR11: n neighbouring tokens joined by a space; none if there are fewer."""
    out = c
    for i in range(1, n):
        # what is beyond the end is null, and so is what is joined with it
        out = F.zip_with(out, F.slice(c, F.lit(i + 1), F.greatest(F.size(c), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(F.coalesce(out, F.array().cast("array<string>")), lambda g: g.isNotNull())


def letters(c: Column, n: int) -> Column:
    """STR15: all runs of n characters of the lower-case text, also across words."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1))


def with_bigrams(c: Column) -> Column:
    """STR10, TXT1: tokens followed by their bigrams."""
    return F.concat(c, ngrams(c, 2))


def normal_name(c: Column) -> Column:
    """STR2: lower-case without ASCII punctuation."""
    return F.translate(F.lower(c), PUNCTUATION, "")


def plain_name(c: Column) -> Column:
    """STR3: STR2 after the accents of Western European letters are dropped."""
    return normal_name(F.translate(c, "àáâãäåçèéêëìíîïñòóôõöùúûüýÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyAAAAAACEEEEIIIINOOOOOUUUUY"))


def similar_name(a: Column, b: Column, max_edits: int = 2) -> Column:
    """STR4: fewer edits than ``max_edits`` between the normal names."""
    return F.levenshtein(normal_name(a), normal_name(b)) < max_edits


def positional_match(a: Column, b: Column) -> Column:
    """STR5: share of equal characters at equal places of the shorter name; null if empty."""
    n = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))).cast("int"))
    return F.when(n > 0, same / n)


def edge_stripped(c: Column) -> Column:
    """STR6: white-space tokens without punctuation at their edges."""
    return F.transform(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""), lambda w: F.btrim(w, F.lit(PUNCTUATION)))


def sentences(c: Column) -> Column:
    """STR16: sentences by their end marks."""
    return F.split(c, r"(?<=[.!?])\s+")


def first_sentences(c: Column, n: int = 3) -> Column:
    """STR17: at most the first n sentences."""
    return F.array_join(F.slice(sentences(c), 1, n), " ")


def without_boilerplate(c: Column, phrases: str, name: Column | None = None) -> Column:
    """STR16: sentences that don't match ``phrases``, without ``[source…]`` notes and
    the company's name."""
    kept = F.array_join(F.filter(sentences(c), lambda s: ~s.rlike(phrases)), " ")
    kept = F.regexp_replace(kept, r"\[source[^\]]*\]", "")
    return kept if name is None else F.replace(kept, name, F.lit(""))


def language(c: Column) -> Column:
    """STR15: the language with most of its function words in the text; en on ties."""
    # Frequent function words.
    votes = {"en": "the of and to in is that for", "de": "der die und das nicht ist mit von", "fr": "le la les et des une est dans", "es": "el los las que una por con del"}
    own = F.split(F.lower(c), r"\W+")

    def hits(listed: list[str]) -> Column:
        return F.size(F.filter(own, lambda w: w.isin(*listed)))

    count = {k: hits(v.split()) for k, v in votes.items()}
    best = F.greatest(*count.values())
    return reduce(lambda rest, k: F.when(count[k] == best, k).otherwise(rest), reversed(list(count)), F.lit("en"))


def clean_keyword(c: Column) -> Column:
    """STR20: marks but the apostrophe to spaces, words of two letters and more, lower."""
    marks = PUNCTUATION.replace("'", "")
    return F.array_join(F.filter(F.split(F.translate(F.lower(c), marks, " " * len(marks)), r"\s+"), lambda w: F.length(w) > 1), " ")


def money(value: Column, currency: Column, magnitude: Column) -> Column:
    """STR19: ``EUR 1.5m``; N/A for null; nan, inf and -inf as in C."""
    number = F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").otherwise(F.format_string("%.1f", value))
    return F.when(value.isNull(), "N/A").otherwise(F.concat(F.coalesce(F.concat(currency, F.lit(" ")), F.lit("")), number, F.coalesce(magnitude, F.lit(""))))


def money_range(c: Column, rate: float = 1.0) -> Column:
    """STR21: the bounds of ``2m-5m``, or a tenth and ten times of a single value."""

    def one(x: Column) -> Column:
        n = F.expr("try_cast(null as double)") if x is None else F.regexp_extract(x, "([0-9.]+)", 1).try_cast("double")
        unit = F.regexp_extract(x, "[0-9.]+ *([bmk])", 1)
        return n * F.when(unit == "b", 1e9).when(unit == "m", 1e6).when(unit == "k", 1e3).otherwise(1.0) * rate

    parts = F.split(F.lower(c), "-")
    low, high = one(F.get(parts, F.lit(0))), one(F.get(parts, F.lit(1)))
    return F.struct(F.coalesce(F.when(F.size(parts) > 1, low), low / 10).alias("low"), F.coalesce(F.when(F.size(parts) > 1, high), low * 10).alias("high"))


def html_text(c: Column) -> Column:
    """WEB4: text of HTML by patterns: scripts, styles, comments and tags out, the
    five basic entities decoded, spaces collapsed."""
    out = F.regexp_replace(c, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", " ")
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(mark))
    return F.trim(F.regexp_replace(out, r"[ \n\t\r]+", " "))


def fold_lines(c: Column) -> Column:
    """WEB7: a text on one line: line ends are ``þ0`` and a letter þ of the text is ``þ1``,
    so that ``unfold_lines`` gives every text back."""
    return F.replace(F.replace(c, F.lit("þ"), F.lit("þ1")), F.lit("\n"), F.lit("þ0"))


def unfold_lines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("þ0"), F.lit("\n")), F.lit("þ1"), F.lit("þ"))


def first_sentence(c: Column) -> Column:
    """A text to its first mark that ends a sentence, or whole."""
    found = F.regexp_extract(c, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    return F.when(found == "", c).otherwise(found)


def pattern_is(text: Column, name: Column) -> Column:
    """TXT21: where ``is`` follows the name within 30 characters, the sentence that begins
    with the name, to a mark of markup at most; a sentence that ends in ``Inc.`` or ``U.S.``
    takes the next one too. Null unless it has over five words; case counts."""
    at = F.instr(text, name)
    near = F.substring(text, at, F.length(name) + 30).contains(" is ")
    rest = F.regexp_extract(F.substring(text, at, F.length(text)), r"(?s)^[^*#|>]*", 0)
    one = first_sentence(rest)
    more = F.ltrim(F.substring(rest, F.length(one) + 1, F.length(rest)))
    whole = F.when(one.rlike(r"(?:^|\s)(?:Inc|U\.S)\.$") & (more != ""), F.concat(one, F.lit(" "), first_sentence(more))).otherwise(one)
    return F.when((at > 0) & (F.length(name) > 0) & near & (F.regexp_count(whole, F.lit(r"\S+")) > 5), F.replace(whole, F.lit("\n"), F.lit(" ")))


# Headings that say who a company is.
ABOUT = "# who we are|# overview|# company overview|# about|# mission|# our mission"


def who_we_are(text: Column) -> Column:
    """TXT22: the lines under a heading that says who the company is, up to an empty one, as
    one line; of several the last that has over five words and isn't a list. A heading that
    comes next loses its mark. Null if there is none."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)(?:{ABOUT})[^\n]*(?=\n+([^\n]+(?:\n[^\n]+)*))"), F.lit(1))
    lines = F.transform(found, lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    good = F.filter(lines, lambda p: (F.regexp_count(p, F.lit(r"\S+")) > 5) & ~p.startswith("*"))
    last = F.get(F.reverse(good), F.lit(0))
    return F.when(last.startswith("#"), F.regexp_replace(last, r"^\S+ ", "")).otherwise(last)


def headed_text(html: Column) -> Column:
    """A page's text in lines: headings are marked with #, blocks end lines, other tags go."""
    out = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<title.*?</title>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"(?i)<h[1-6][^>]*>", "\n\n# ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)</(?:h[1-6]|p|div|li|tr)>|<br[^>]*>", "\n"), r"<[^>]*>", "")
    return F.trim(F.regexp_replace(out, r" *\n *", "\n"))


def subsidiary_of(text: Column) -> Column:
    """TXT23: the parent named in the last three sentences."""
    last = F.array_join(F.reverse(F.slice(F.reverse(sentences(text)), 1, 3)), " ")
    found = F.regexp_extract(last, r"(?i)subsidiary of (.+?)[.,]", 1)
    return F.when(found != "", F.trim(found))
