"""Text functions of the question bank, as columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the white space of ECMAScript, as a Java and RE2 character class body.
SPACE = r"\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


#: The same, as a string of characters.
SPACES = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is evaluated once however often f names it: Spark puts an expression in place of each mention, also within functions of elements."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no function for it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normal_form(x: Column) -> Column:
    """ASCII texts are left alone, and are nulls to the Python function: Spark calls it on every row, wherever it stands."""
    return F.coalesce(nfkc(F.when(x.rlike(r"[^\x00-\x7F]"), x)), x)


#: What texts that collapsing leaves alone don't have: they are printable ASCII with single spaces within.
UNEVEN = r"[^\x20-\x7E]|^ |  | $"


def collapsed(x: Column) -> Column:
    """White space runs to one space, ends trimmed. Most texts are even, and seen by one pattern."""
    return F.when(~x.rlike(UNEVEN), x).otherwise(F.trim(F.regexp_replace(x, f"[{SPACE}]+", " ")))


def content_hash(x: Column) -> Column:
    """Loose hash: lower case, trimmed, then without anything but word characters and spaces."""
    return F.sha2(F.regexp_replace(trimmed(F.lower(x)), rf"[^\w{SPACE}]", ""), 256)


def exact_hash(question: Column, options: Column) -> Column:
    """Hash of the question and its options in order; options are structs of id and text."""
    lines = F.array_join(F.transform(options, lambda o: F.concat(o["id"], F.lit("."), o["text"])), "\n")
    return F.sha2(F.concat(question, F.lit("\n"), lines), 256)


def _json(x: Column) -> Column:
    """A JSON string literal."""
    return F.substring(F.to_json(F.array(x)), 2, 1 << 30).substr(F.lit(1), F.length(F.to_json(F.array(x))) - 2)


def fingerprint(question: Column, options: Column, labels: Column, explanation: Column) -> Column:
    """Hash of exactly what an audit judged: question, options, key and explanation, as one JSON array."""
    pairs = F.array_join(F.transform(options, lambda o: F.to_json(F.array(o["id"], o["text"]))), ",")
    parts = [_json(question), F.concat(F.lit("["), pairs, F.lit("]")), F.to_json(labels), F.coalesce(_json(explanation), F.lit("null"))]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def normal_line(x: Column) -> Column:
    """Form feeds dropped, quotes and dashes straightened, white space collapsed. Most lines are printable ASCII with single spaces within, which stay as they are."""
    return F.when(~x.rlike(UNEVEN), x).otherwise(collapsed(F.translate(F.regexp_replace(x, "\f", ""), "“”‘’–—", "\"\"''--")))


def cleaned(x: Column) -> Column:
    """Extracted text without page markers, loose fi/fl pieces, pipes and underscores. Even texts with none of these, which are most, are seen by one pattern."""
    own = x
    x = F.regexp_replace(x, r"\[PDF_(PAGE|SOURCE)[^\]]*\]", " ")
    for piece in ("fi", "fl"):
        x = F.regexp_replace(x, rf"(?i)(?<!\w){piece}\s+{piece}(?!\w)", " ")
    x = F.regexp_replace(x, r"(?i)\bfi(?:\s+fi|\s+fl){2,}\b", " ")
    x = F.regexp_replace(x, r"(?i)\bfl(?:\s+fi|\s+fl){2,}\b", " ")
    return F.when(~own.rlike(rf"{UNEVEN}|[|_]|[fF][iIlL] "), own).otherwise(collapsed(F.regexp_replace(x, r"\s*[|_]+\s*", " ")))


def unnumbered(x: Column) -> Column:
    return F.regexp_replace(x, r"^\d{1,3}[.)]\s*", "")


def folded(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def prefix(x: Column, n: int = 12) -> Column:
    return F.substring(folded(x), 1, n)


def word_set(x: Column, least: int = 3) -> Column:
    """Distinct runs of at least ``least`` ASCII letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0)))


def long_tokens(x: Column) -> Column:
    """Distinct tokens of over two characters, anything but ASCII letters and digits apart."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(x), "[^a-z0-9]", " "), " +"), lambda t: F.length(t) > 2))


def letter_words(x: Column) -> Column:
    """Runs of three or more ASCII letters that touch no apostrophe, repeats kept."""
    return F.regexp_extract_all(x, F.lit("(?<![A-Za-z'’])[A-Za-z]{3,}(?![A-Za-z'’])"), F.lit(0))


def without_stray_cjk(x: Column) -> Column:
    cjk, latin = F.regexp_count(x, F.lit(r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]")), F.regexp_count(x, F.lit("[A-Za-z]"))
    return F.when((cjk > 0) & (latin >= cjk * 10), F.regexp_replace(x, r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]", "")).otherwise(x)


def without_ligature_debris(x: Column) -> Column:
    return F.trim(F.regexp_replace(collapsed(x), r"(?:\s+(?:ffi|ffl|fi|fl|ff))+$", ""))


def usable_text_layer(x: Column, least: int = 50) -> Column:
    """Whether a page's text layer holds enough to be used instead of OCR."""
    return F.length(F.regexp_replace(x, f"[{SPACE}]", "")) >= least


def safe_file_name(x: Column) -> Column:
    return F.regexp_replace(x, "[^a-zA-Z0-9._-]", "_")


def short(x: Column, n: int) -> Column:
    """Null to empty, trimmed, cut to n characters."""
    return F.substring(trimmed(F.coalesce(x, F.lit(""))), 1, n)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column, least: int = 5) -> Column:
    """Share of the smaller set that the larger holds; 0 if the smaller has fewer than ``least`` words."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller < least, 0.0).otherwise(F.size(F.array_intersect(a, b)) / smaller)


def answers_agree(key_a: Column, key_b: Column, text_a: Column, text_b: Column) -> Column:
    """Empty, equal, one a prefix of the other (8 characters at least), or much the same words."""
    shorter = F.when(F.length(key_a) <= F.length(key_b), key_a).otherwise(key_b)
    longer = F.when(F.length(key_a) <= F.length(key_b), key_b).otherwise(key_a)
    same = F.when(F.length(shorter) >= 8, F.startswith(longer, shorter)).otherwise(shorter == longer)
    return (key_a == "") | (key_b == "") | same | (jaccard(word_set(text_a, 2), word_set(text_b, 2)) >= 0.6)


def chunk_kind(x: Column) -> Column:
    """definition, structure or context. Words end at anything but ASCII letters, digits and _, as in the reference; Java's word boundary takes letters of other scripts for parts of a word."""
    low = F.lower(x)
    structure = low.rlike("syllabus|table of contents|chapter|unit|lesson|objective|outline|subtopic|scope") | low.rlike(r"(^|\n)(\d+\.|[ivx]+\.)\s+")
    definition = low.rlike(r"((?<!\w)(exam|test|level|explanation|explain|language|bilingual|japanese|english|n2|n1|format|style|must|should)(?!\w)|answer in|output in)") & (F.length(x) < 1200)
    return F.when(definition, "definition").when(structure, "structure").otherwise("context")


def chunk_confidence(kind: Column) -> Column:
    return F.when(kind == "context", 0.6).otherwise(0.7)


def section_kind(heading: Column) -> Column:
    return F.when(heading.rlike("(?i)^Sample Questions"), "example_question").when(heading.rlike("(?i)^Sample Exam"), "exam_question").otherwise("chapter_question")


def repair_flags(question: Column, options: Column, labels: Column, correct: Column) -> Column:
    """Names of the defects of a record, in a fixed order."""
    texts = F.transform(options, lambda o: o["text"])
    whole = F.concat_ws(" ", question, F.array_join(texts, " "))
    swallowed = F.exists(texts, lambda t: (F.length(t) > 420) | t.rlike(r"\s+\d{1,3}[.)]\s+[A-Z]") | t.rlike(r"[.!?]\s+[A-D][.)]\s+"))
    rules = [
        (F.size(options) != 4, "missing_or_extra_options"),
        (question.rlike(r"\s+\d{1,3}[.)]\s+[A-Z][^.?!]{15,}"), "merged_numbered_question"),
        (question.rlike(r"(?<!\w)A[.)]\s+[^B]+B[.)]\s+[^C]+C[.)]"), "prompt_contains_options"),
        (swallowed, "option_swallowed_text"),
        (F.length(question) < 12, "too_short_prompt"),
        (whole.rlike(r"(?i)would The owner|B\. Riparian rights are water rights|\[PDF_(PAGE|SOURCE)\b|fi(?:\s+fi){2,}|fl(?:\s+fi|\s+fl){2,}"), "explicit_ocr_layout_pollution"),
        (F.size(labels) == 0, "no_answer_label"),
        ((F.size(labels) > 0) & (F.size(correct) != F.size(labels)), "answer_label_not_in_options"),
    ]
    return F.array_compact(F.array(*[F.when(rule, name) for rule, name in rules]))


def _polluted(flags: Column) -> Column:
    return F.size(F.array_except(flags, F.array(F.lit("no_answer_label"), F.lit("answer_label_not_in_options")))) > 0


def confidence(question: Column, options: Column, labels: Column, correct: Column, explanation: Column, flags: Column) -> Column:
    """In hundredths until the end, so no rounding drifts."""
    on = lambda cond, n: F.when(cond, n).otherwise(0)
    keyed = (F.size(labels) > 0) & (F.size(correct) == F.size(labels))
    points = F.lit(45) + on(F.length(question) > 20, 15) + on(F.size(options) == 4, 20) + on(keyed, 15) + on(F.coalesce(explanation, F.lit("")) != "", 5)
    capped = (F.size(labels) == 0) | (F.size(correct) == 0) | (F.size(options) != 4) | _polluted(flags)
    return F.least(F.when(capped, F.least(points, F.lit(75))).otherwise(points), F.lit(100)) / 100.0


def review_status(options: Column, flags: Column, actions_applied: Column, conf: Column) -> Column:
    broken = (F.size(options) != 4) | _polluted(flags) | F.array_contains(flags, "answer_label_not_in_options")
    return F.when(broken, "needs_repair").when(F.array_contains(flags, "no_answer_label"), "needs_user_review").when(actions_applied, "auto_repaired").when(conf >= 0.75, "ready").otherwise("needs_user_review")


def review_reason(labels: Column, options: Column) -> Column:
    return F.when(F.size(labels) == 0, "Missing answer").when(F.size(options) != 4, "Expected four answer options").otherwise("Low confidence OCR extraction")


def servable(status: Column) -> Column:
    return F.coalesce(status.isin("ready", "auto_repaired"), F.lit(False))


def verdict_fails(complete: Column, clean: Column, key: Column) -> Column:
    return ~complete | ~clean | (key != "correct")


def rounded(x: Column) -> Column:
    """Half up, as a whole number."""
    return F.floor(x + 0.5).cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage; null for nothing out of nothing."""
    return rounded(F.try_divide(part.cast("double") * 100.0, whole))


def upper_median(values: Column) -> Column:
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def countdown(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def score_band(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 50, "middle").otherwise("low")


def toggled(answers: Column, index: Column, multiple: Column) -> Column:
    """An answer picked again goes, if several may be picked; else the pick replaces what was there."""
    return F.when(~multiple, F.array(index)).when(F.array_contains(answers, index), F.array_remove(answers, index)).otherwise(F.array_append(answers, index))


def json_object(x: Column) -> Column:
    """The whole text as a variant, else its widest {...}, else null."""
    return F.coalesce(F.try_parse_json(x), F.try_parse_json(F.regexp_extract(x, r"(?s)\{.*\}", 0)))
