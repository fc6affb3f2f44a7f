"""Row-local text measures as column expressions.

Everything here stays in the JVM and needs no shuffle: a document never leaves
its row. Counts over a whole text use ``regexp_count`` (one pass, no arrays);
arrays are built only where the measure compares sentences with each other.
White space is ASCII white space, tokens are runs of letters or digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentflow.vocab import ENGLISH_STOP_WORDS

WS = " \t\n\r\f"
WS_RE = r"[ \t\n\r\f]+"
TOKEN_RE = r"[\p{L}\p{N}]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(WS))


def is_blank(c) -> Column:
    return col(c).isNull() | (F.length(strip(c)) == 0)


def words(c) -> Column:
    return F.filter(F.split(col(c), WS_RE), lambda w: w != "")


def word_count(c) -> Column:
    return F.regexp_count(col(c), F.lit(r"[^ \t\n\r\f]+"))


def tokens(c) -> Column:
    """Lower-case runs of letters or digits."""
    return tokens_of_lower(F.lower(col(c)))


def tokens_of_lower(lower) -> Column:
    """:func:`tokens` of a text in lower case."""
    return F.regexp_extract_all(col(lower), F.lit(TOKEN_RE), F.lit(0))


def content_tokens(c, stop_words=ENGLISH_STOP_WORDS) -> Column:
    return F.filter(tokens(c), lambda t: ~t.isin(list(stop_words)))


def alpha_tokens(c) -> Column:
    return F.filter(tokens(c), lambda t: t.rlike(r"^\p{L}+$"))


def sentences(c) -> Column:
    """Pieces between runs of ``.!?``, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(col(c), r"[.!?]+"), strip), lambda s: s != "")


def sentences_with_end(c) -> Column:
    """Like :func:`sentences` but every piece keeps its closing marks."""
    return F.filter(
        F.transform(F.regexp_extract_all(col(c), F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), strip),
        lambda s: s.rlike(r"[^ \t\n\r\f.!?]"),
    )


def period_pieces(c) -> Column:
    """Pieces between ``". "``; nothing is dropped."""
    return F.split(col(c), r"\. ")


def strip_tags(c) -> Column:
    return F.regexp_replace(col(c), "<[^>]+>", "")


def rounded(c, places: int) -> Column:
    """``F.round`` of a double without a decimal number for each row: only values near a tie, and large ones, go through it."""
    v, unit = col(c), 10.0 ** places
    clear = (F.abs(v) * unit < 1e12) & (F.abs(v * unit - F.floor(v * unit) - 0.5) > 1e-3)
    return F.when(clear, F.floor(v * unit + 0.5) / unit).otherwise(F.round(v, places))


def ratio(a, b, empty: float = 0.0) -> Column:
    """a / b with each side evaluated once; ``empty`` when b is zero."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(empty))


def let(values: dict[str, Column], body) -> Column:
    """``body(v)`` with each value evaluated once per row, however often ``v[name]`` occurs
    and whatever branch it occurs in."""
    row = F.struct(*[c.alias(n) for n, c in values.items()])
    return F.get(F.transform(F.array(row), lambda v: body(v)), F.lit(0))


def clamp(c, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


# --- readability ---------------------------------------------------------------

def clean_for_reading(c) -> Column:
    return strip(F.regexp_replace(col(c), r"[^a-zA-Z \t\n\r\f.]", ""))


def terminal_sentence_count(c) -> Column:
    return F.size(F.filter(F.split(col(c), r"[.!?]+"), lambda s: F.length(strip(s)) > 0))


def syllables(c) -> Column:
    """Syllables of all words of an already cleaned text.

    Per word: vowel groups, minus a final ``e``, plus a final consonant+``le``, at least
    one. Over the text that is three counts: groups that are not a final ``...e``, words
    with the ``le`` ending, and words the first two rules leave without any."""
    def n(low, pattern):
        return F.regexp_count(low, F.lit(pattern))

    return let({"low": F.lower(col(c))}, lambda v: (
        n(v["low"], r"[aeiouy]++(?<!e(?!\S))")
        + n(v["low"], r"[^aeiouy\s]le(?!\S)")
        + n(v["low"], r"(?<!\S)(?=\S)[^aeiouy\s]*+(?:[aeiouy]*+(?<=e))?(?!\S)(?<![^aeiouy\s]le)")))


def flesch(words_n, sentences_n, syllables_n) -> Column:
    """Arguments are cheap references; zero words or sentences give 0."""
    w, s = F.nullif(words_n.cast("double"), F.lit(0.0)), F.nullif(sentences_n.cast("double"), F.lit(0.0))
    score = 206.835 - 1.015 * (w / s) - 84.6 * (syllables_n / w)
    return F.when(w.isNull() | s.isNull(), F.lit(0.0)).otherwise(clamp(score, 0.0, 100.0))


def flesch_by_groups(c) -> Column:
    counted = lambda t: {"w": word_count(t), "s": terminal_sentence_count(t), "v": syllables(t)}
    return let({"t": clean_for_reading(c)}, lambda v: let(counted(v["t"]), lambda n: flesch(n["w"], n["s"], n["v"])))


def token_count(c) -> Column:
    return F.regexp_count(col(c), F.lit(TOKEN_RE))


def flesch_by_letters(c) -> Column:
    """Vowel letters stand in for syllables."""
    return flesch_of_counts(token_count(c), F.size(sentences(c)), F.lower(col(c)))


def flesch_of_counts(n_tokens, n_sentences, lower) -> Column:
    """:func:`flesch_by_letters` of a text whose tokens and sentences are counted already; ``lower`` is the text in lower case."""
    counted = {"w": col(n_tokens), "s": col(n_sentences), "v": F.regexp_count(col(lower), F.lit("[aeiou]"))}
    return let(counted, lambda n: flesch(n["w"], n["s"], n["v"]))


def readability_ideal_length(c) -> Column:
    """1 at 15 words per sentence, falling to 0 ten words away from it."""
    return let({"w": word_count(c), "s": F.size(period_pieces(c))}, lambda n: F.when(
        n["w"] > 0, 1 - F.least(F.abs(n["w"] / n["s"] - 15) / 10, F.lit(1.0))).otherwise(F.lit(0.0)))


def readability_with_penalties(c) -> Column:
    counted = {"n": F.length(col(c)), "chars": F.length(F.regexp_replace(col(c), WS_RE, "")), "w": word_count(c),
               "s": F.size(F.split(col(c), r"\."))}

    def score(v):
        sentence_penalty = F.greatest(F.lit(0.0), (v["w"] / v["s"] - 20) / 20)
        word_penalty = F.greatest(F.lit(0.0), (v["chars"] / F.nullif(v["w"], F.lit(0)) - 6) / 4)
        return (F.when(v["n"] == 0, F.lit(0.0)).when(v["w"] == 0, F.lit(0.8))
                .otherwise(clamp(1 - (sentence_penalty + word_penalty) / 2, 0.0, 1.0)))

    return let(counted, score)


# --- coherence, engagement, originality ---------------------------------------------
# These take arrays: a caller that needs several of them keeps the arrays as columns,
# so each text is cut once. Folds use a finish step, so they run once per row.

def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 when both are empty."""
    return F.coalesce(F.try_divide((F.size(a) + F.size(b)).cast("double"), F.size(F.array_union(a, b)).cast("double")) - 1, F.lit(0.0))


def mean_of(arr) -> Column:
    """Mean of an array of numbers, null when it is empty."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"))
    return F.aggregate(
        col(arr), start, lambda a, v: F.struct((a["n"] + 1).alias("n"), (a["s"] + v).alias("s")),
        lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))


def word_sets(pieces: Column) -> Column:
    return F.transform(pieces, lambda s: F.array_distinct(words(F.lower(s))))


def token_sets(pieces: Column) -> Column:
    return F.transform(pieces, lambda s: F.array_distinct(tokens(s)))


def neighbour_scores(sets, skip_empty: bool = True) -> Column:
    """Jaccard scores of neighbouring sets. A pair with an empty side is left out, or counts as zero without ``skip_empty``."""
    arr = col(sets)
    n = F.greatest(F.size(arr) - 1, F.lit(0))
    none = F.lit(None).cast("double") if skip_empty else F.lit(0.0)
    scores = F.zip_with(F.slice(arr, F.lit(1), n), F.slice(arr, F.lit(2), n), lambda a, b: F.when(
        (F.size(a) > 0) & (F.size(b) > 0), (F.size(a) + F.size(b)) / F.size(F.array_union(a, b)) - 1).otherwise(none))
    return F.array_compact(scores) if skip_empty else scores


def fold_neighbours(sets, finish, low_below: float = 0.3, skip_empty: bool = True) -> Column:
    """``finish`` over the neighbours' scores: ``size`` sets, ``n`` scores, ``low`` of them below the limit, their ``total``."""
    return let({"size": F.array_size(col(sets)), "scores": neighbour_scores(sets, skip_empty)}, lambda v: let({
        "size": v["size"], "n": F.size(v["scores"]), "low": F.size(F.filter(v["scores"], lambda s: s < low_below)),
        "total": F.aggregate(v["scores"], F.lit(0.0), lambda t, s: t + s)}, lambda a: F.when(a["size"].isNotNull(), finish(a))))


def coherence_of(sets) -> Column:
    """Mean overlap of neighbours: 1 for a single piece, 0.5 when no pair is usable."""
    return fold_neighbours(sets, lambda a: F.when(a["size"] < 2, F.lit(1.0)).when(a["n"] == 0, F.lit(0.5))
                           .otherwise(a["total"] / a["n"]))


def shift_coherence_of(sets, shift_below: float = 0.3) -> Column:
    """Mean neighbour similarity averaged with the share of steady transitions."""
    return fold_neighbours(
        sets, lambda a: F.when(a["size"] < 2, F.lit(1.0)).when(a["n"] == 0, F.lit(0.5))
        .otherwise(clamp((a["total"] / a["n"] + 1 - a["low"] / a["n"]) / 2, 0.0, 1.0)), shift_below, skip_empty=False)


def coherence(c) -> Column:
    return coherence_of(word_sets(period_pieces(c)))


def shift_coherence(c) -> Column:
    return shift_coherence_of(token_sets(sentences(c)))


def sentence_variety(marked_sentences, lengths=None) -> Column:
    """0.2 x capped variance of the sentence lengths + 0.4 x capped share of questions and exclamations.

    ``lengths`` may hold the numbers of tokens of the sentences where they are known."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0).alias("m"))
    marked = col(marked_sentences)
    counts = F.transform(marked, token_count) if lengths is None else col(lengths)
    rows = F.zip_with(marked, counts, lambda s, n: F.struct(
        n.cast("double").alias("len"), (s.endswith("?") | s.endswith("!")).cast("int").alias("mark")))
    return F.aggregate(
        rows, start,
        lambda a, r: F.struct((a["n"] + 1).alias("n"), (a["s"] + r["len"]).alias("s"),
                              (a["q"] + r["len"] * r["len"]).alias("q"), (a["m"] + r["mark"]).alias("m")),
        lambda a: F.when(a["n"] == 0, F.lit(0.0)).otherwise(
            F.least(F.greatest(a["q"] / a["n"] - (a["s"] / a["n"]) * (a["s"] / a["n"]), F.lit(0.0)) / 100, F.lit(1.0)) * 0.2
            + F.least(a["m"] / a["n"] * 2, F.lit(1.0)) * 0.4))


def engagement_of(marked_sentences, alpha, lengths=None) -> Column:
    rich = ratio(F.size(F.array_distinct(col(alpha))), F.size(col(alpha)))
    return clamp(rich * 0.4 + sentence_variety(marked_sentences, lengths), 0.0, 1.0)


def phrases(c, stop_words=ENGLISH_STOP_WORDS) -> Column:
    """Runs of content words between stop words, digits and punctuation."""
    return phrases_of_lower(F.lower(col(c)), stop_words)


def phrases_of_lower(lower, stop_words=ENGLISH_STOP_WORDS) -> Column:
    """:func:`phrases` of a text in lower case."""
    parts = F.split(F.regexp_replace(col(lower), r"[^\p{L} \t\n\r\f]+", " | "), WS_RE)
    marked = F.transform(parts, lambda t: F.when(t.isin(list(stop_words)), F.lit("|")).otherwise(t))
    return F.filter(F.transform(F.split(F.array_join(marked, " "), r"\|"), lambda p: F.trim(p)), lambda p: p != "")


def sentence_shapes(pieces) -> Column:
    """One string per sentence: N number, C capitalised word, w other word."""
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def shape(s):
        firsts = F.regexp_replace(s, r"([\p{L}\p{N}])[\p{L}\p{N}]*+[^\p{L}\p{N}]*+|^[^\p{L}\p{N}]++", "$1")
        return F.regexp_replace(F.translate(firsts, upper + digits, "C" * len(upper) + "N" * len(digits)), "[^CN]", "w")
    return F.transform(col(pieces), shape)


def originality_of(phrase_array, shape_array) -> Column:
    ph, sh = col(phrase_array), col(shape_array)
    score = ratio(F.size(F.array_distinct(ph)), F.size(ph)) * 0.6 + ratio(F.size(F.array_distinct(sh)), F.size(sh)) * 0.4
    return clamp(score, 0.0, 1.0)


# Rule-based entities: money, percentages, dates, then runs of capitalised words.
ENTITY_RE = (
    r"\$[0-9][0-9,]*(?:\.[0-9]+)?"
    r"|[0-9]+(?:\.[0-9]+)?%"
    r"|[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"|(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4}"
    r"|[A-Z][a-z]+(?: [A-Z][a-z]+)+"
)
# The same matches for Java: a look at one character rules out most places, and no run is tried twice.
ENTITY_SCAN_RE = (
    r"(?=[$0-9A-Z])(?:\$[0-9][0-9,]*+(?:\.[0-9]++)?+"
    r"|[0-9]++(?:\.[0-9]++)?+%"
    r"|[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"|(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4}"
    r"|[A-Z][a-z]++(?: [A-Z][a-z]++)++)"
)


def entities(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(ENTITY_SCAN_RE), F.lit(0))


def entity_label(e) -> Column:
    e = col(e)
    return (
        F.when(e.startswith("$"), "MONEY")
        .when(e.endswith("%"), "PERCENT")
        .when(e.rlike(r"[0-9]"), "DATE")
        .when(e.rlike(r" (Inc|Corp|Ltd|Company|University)$"), "ORG")
        .otherwise("PERSON")
    )


def fact_density_of(entity_array, numbers, n_tokens) -> Column:
    found, n = col(entity_array), col(n_tokens)
    hard = F.size(F.filter(found, lambda e: entity_label(e).isin("DATE", "GPE", "ORG", "MONEY", "PERCENT")))
    return F.when(n > 0, F.least(3.0 * (F.size(found) + col(numbers) + hard) / n, F.lit(1.0))).otherwise(F.lit(0.0))


# --- summaries -----------------------------------------------------------------------

def brief(c, limit: int = 200) -> Column:
    """First ``limit`` characters, trimmed, always with an ellipsis."""
    return F.concat(strip(F.substring(col(c), 1, limit)), F.lit("..."))


def short_summary(c, limit: int = 200) -> Column:
    """The whole text when short enough, else its first ``limit`` characters and an ellipsis."""
    return F.when(F.length(col(c)) <= limit, col(c)).otherwise(
        F.concat(F.substring(col(c), 1, limit), F.lit("...")))


def agreement_confidence(first, second) -> Column:
    """0.4 word overlap + 0.3 length balance + 0.3 mean readability of two summaries."""
    parts = {
        "a": F.array_distinct(words(F.lower(col(first)))), "b": F.array_distinct(words(F.lower(col(second)))),
        "na": word_count(first), "nb": word_count(second),
        "r": (readability_ideal_length(first) + readability_ideal_length(second)) / 2,
    }
    return let(parts, lambda v: F.when((v["na"] == 0) & (v["nb"] == 0), F.lit(0.0)).otherwise(clamp(
        0.4 * jaccard(v["a"], v["b"]) + 0.3 * ratio(F.least(v["na"], v["nb"]), F.greatest(v["na"], v["nb"])) + 0.3 * v["r"], 0.0, 1.0)))


def vocabulary_hits(c, vocabulary) -> Column:
    """Number of tokens that belong to a vocabulary."""
    return hits(tokens(c), vocabulary)


def hits(token_array, vocabulary) -> Column:
    return F.size(F.filter(col(token_array), lambda t: t.isin(list(vocabulary))))


def most_repeated(arr) -> Column:
    """Highest number of equal elements: sort, then follow the runs inside the row."""
    start = F.struct(F.lit("").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, x):
        run = F.when(x == acc["prev"], acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("prev"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.array_sort(col(arr)), start, step)["best"]


def longest_first(arr, n: int) -> Column:
    """Up to ``n`` distinct strings, longest first, then alphabetical."""
    keyed = F.transform(F.array_distinct(col(arr)), lambda p: F.struct((-F.length(p)).alias("k"), p.alias("p")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda s: s["p"])


def language_of(token_array, profiles: dict[str, list[str]], default: str = "en") -> Column:
    """Language whose function words occur most; ties go to the first name."""
    names = sorted(profiles)

    def pick(v):
        best = F.greatest(*[v[n] for n in names])
        out = F.when(best == 0, default)
        for n in names:
            out = out.when(v[n] == best, n)
        return out

    return let({n: hits(token_array, profiles[n]) for n in names}, pick)


def around(text, start, end, margin: int = 50) -> Column:
    """Text between ``margin`` characters before ``start`` and after ``end`` (0-based, end exclusive)."""
    lo = F.greatest(F.lit(0), col(start) - margin)
    hi = F.least(F.length(col(text)), col(end) + margin)
    return F.substring(col(text), lo + 1, hi - lo)


def sorted_tokens(c) -> Column:
    return F.sort_array(tokens(c))


def _without_common_start(a: Column, b: Column) -> Column:
    """Struct of two arrays without the elements they begin with in common."""
    same = F.zip_with(a, b, lambda v, w: F.coalesce(v == w, F.lit(False)))
    n = let({"at": F.array_position(same, F.lit(False))}, lambda v: F.when(v["at"] > 0, v["at"] - 1).otherwise(F.size(a)).cast("int"))
    return let({"n": n}, lambda v: F.struct(F.slice(a, v["n"] + 1, F.greatest(F.size(a), F.lit(1))).alias("a"),
                                            F.slice(b, v["n"] + 1, F.greatest(F.size(b), F.lit(1))).alias("b")))


def word_list_distance(a: Column, b: Column, most: Column) -> Column:
    """Edit distance of two lists of words, each not empty and joined by spaces; null beyond ``most``.

    Words that both lists begin or end with don't change the distance and are left out first."""
    def ended(words):
        return F.array_join(F.transform(words, lambda w: F.concat(w, F.lit(" "))), "")

    def rest(v):
        return _without_common_start(F.reverse(v["r"]["a"]), F.reverse(v["r"]["b"]))

    def measured(v):
        return F.call_function("levenshtein", ended(F.reverse(v["r"]["a"])), ended(F.reverse(v["r"]["b"])), most)

    found = let({"r": let({"r": _without_common_start(a, b)}, rest)}, measured)
    return F.nullif(found, F.lit(-1))


def source_context(fact, content, ratio_above: float = 80.0, content_tokens_sorted=None) -> Column:
    """Surroundings of an exact hit, the whole text for a near match of sorted words, else null.

    The edit distance is only computed when the lengths allow such a match. ``content_tokens_sorted`` may hold
    :func:`sorted_tokens` of the content where many facts meet one content."""
    fact, content = col(fact), col(content)
    theirs = sorted_tokens(content) if content_tokens_sorted is None else col(content_tokens_sorted)

    def joined_length(words):
        return F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w)) + F.size(words) - 1

    def near(v):
        longest, allowed = F.greatest(v["m"], v["n"]), F.greatest(v["m"], v["n"]) * (1 - ratio_above / 100)
        possible = (F.size(v["a"]) > 0) & (F.size(v["b"]) > 0) & (F.abs(v["m"] - v["n"]) <= allowed)
        distance = word_list_distance(v["a"], v["b"], F.ceil(allowed).cast("int"))
        return F.when(possible, F.coalesce(100 * (1 - distance / longest) > ratio_above, F.lit(False))).otherwise(False)

    def sized(v):
        return let({"a": v["a"], "b": v["b"], "m": joined_length(v["a"]), "n": joined_length(v["b"])}, near)

    return let({"at": F.position(fact, content) - 1}, lambda p: F.when(
        p["at"] >= 0, around(content, p["at"], p["at"] + F.length(fact))).when(
        let({"a": sorted_tokens(fact), "b": theirs}, sized), content))


def relevance(summary, body, default: float = 0.8) -> Column:
    """Share of the distinct content words of a summary that occur in the text."""
    return let({"own": F.array_distinct(content_tokens(summary)), "body": F.array_distinct(tokens(body))}, lambda v: ratio(
        F.size(F.array_intersect(v["own"], v["body"])), F.size(v["own"]), default))
