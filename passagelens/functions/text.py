"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python's str methods and \s see it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: The same where it isn't one blank, which stays as it is.
_SPACES = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ABBREVIATED = r"(^|[\s(\"\x02])(Dr|Mr|Mrs|Ms|Prof|St|Jr|Sr|vs|[A-Z])\.\s+"
_SENTENCE_END = r"([.!?][\"')\]]*)\s+([\"'(]?[\p{Lu}0-9])"


def bound(value: Column, use) -> Column:
    """use(value) with value computed once a row, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")


def normalize_text(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, _SPACES, " ")))


def normalize_answer(text: Column) -> Column:
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), SPACE, " "))


def prediction_from_output(raw: Column) -> Column:
    """The first line of a model's output, without its thoughts."""
    return strip(F.split(strip(F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")), r"\r?\n")[0])


def contains_answer(prediction: Column, answer: Column) -> Column:
    p, a = normalize_answer(prediction), normalize_answer(answer)
    space = F.lit(" ")
    return (a != "") & F.contains(F.concat(space, p, space), F.concat(space, a, space))


def exact_match(prediction: Column, answer: Column) -> Column:
    return normalize_answer(prediction) == normalize_answer(answer)


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_answer(text), " "), lambda x: x != "")


def token_f1(prediction: Column, answer: Column) -> Column:
    """F1 of the two bags of tokens."""

    def score(both: Column) -> Column:
        p, a = both["p"], both["a"]
        count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
        shared = F.aggregate(F.array_distinct(p), F.lit(0), lambda s, t: s + F.least(count(p, t), count(a, t)))
        return F.when(shared == 0, 0.0).otherwise(2.0 * shared / (F.size(p) + F.size(a)))

    return bound(F.struct(answer_tokens(prediction).alias("p"), answer_tokens(answer).alias("a")), score)


def search_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _cut(text: Column) -> Column:
    """text split after end marks before a capital, a digit or a quote; abbreviations and initials don't end a sentence."""
    kept = F.regexp_replace(F.regexp_replace(text, _ABBREVIATED, "$1$2.\x02"), _ABBREVIATED, "$1$2.\x02")  # twice: neighbours share a blank
    return F.split(F.replace(F.regexp_replace(kept, _SENTENCE_END, "$1\x01$2"), F.lit("\x02"), F.lit(" ")), "\x01")


def sentences(text: Column) -> Column:
    """Sentences by their end marks. White space before the first stays, that after the last goes; a blank text has none."""
    return F.filter(_cut(F.regexp_replace(text, r"(?U)\s+$", "")), lambda x: x != "")


def long_sentences(text: Column, least: int = 20) -> Column:
    """The stripped sentences of at least so many characters. Only a text's ends can have white space that cutting leaves."""
    return F.filter(_cut(strip(text)), lambda x: F.length(x) >= least)


def clean_text(text: Column) -> Column:
    """Without reference marks, blank lines and table rows; white space collapsed."""
    unmarked = F.regexp_replace(text, r"\[\d+\]", " ")
    bars = lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))
    lines = F.filter(F.transform(F.split(unmarked, "\n"), strip), lambda x: (x != "") & (bars(x) < 2))
    return F.trim(F.regexp_replace(F.array_join(lines, " "), SPACE, " "))


def strip_refs_and_comments(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?is)<ref[^>]*>.*?</ref>", " ")
    out = F.regexp_replace(out, r"(?i)<ref[^>]*/>", " ")
    return F.regexp_replace(out, r"(?s)<!--.*?-->", " ")


#: Names of sections that hold no prose.
SKIPPED_SECTIONS = ("references", "see also", "external links", "notes", "further reading", "bibliography", "sources", "footnotes", "citations", "external link")


def html_sections(html: Column) -> Column:
    """(heading, text) of each part between level-2 headings; the lead has no heading."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|footer)[^>]*>.*?</(script|style|nav|footer)>", " ")

    def section(part: Column, i: Column) -> Column:
        heading = F.when(i > 0, F.trim(F.regexp_replace(F.substring_index(part, "</h2>", 1), r"<[^>]*>", "")))
        body = F.when(i > 0, F.substring(part, F.instr(part, "</h2>") + 5, 1 << 30)).otherwise(part)
        plain = F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", " "), r"\s+", " ")
        return F.struct(heading.alias("heading"), F.trim(plain).alias("text"))

    return F.transform(F.split(bare, r"<h2[^>]*>"), section)


def section_labels(sections: Column) -> Column:
    """For each sentence but the first of all sections (arrays of sentences) whether it begins a section."""
    flags = F.flatten(F.transform(sections, lambda s: F.transform(s, lambda _, j: F.when(j == 0, 1).otherwise(0))))
    return F.slice(flags, F.lit(2), F.greatest(F.size(flags) - 1, F.lit(0)))


def kept_articles(pages: DataFrame, sections: Column, least_section: int, least_article: int) -> DataFrame:
    """pages with sentences and labels (1 where the next sentence begins a section) of sections (heading, text). Sections that hold no prose by their name, or too few
    sentences, are left out, and so are pages with too few sentences in all. The lead has no name."""
    prose = F.filter(sections, lambda s: ~F.lower(F.trim(F.coalesce(s["heading"], F.lit("__lead__")))).isin(*SKIPPED_SECTIONS))
    kept = F.filter(F.transform(prose, lambda s: long_sentences(s["text"])), lambda s: F.size(s) >= least_section)
    parsed = pages.withColumn("_sections", kept).withColumn("sentences", F.flatten("_sections")).where(F.size("sentences") >= least_article)
    return parsed.withColumn("labels", section_labels(F.col("_sections"))).drop("_sections")


def parsed_articles(pages: DataFrame, html: str, least_section: int = 1, least_article: int = 8) -> DataFrame:
    """kept_articles() of a column of HTML, which is dropped."""
    return kept_articles(pages, html_sections(F.col(html)), least_section, least_article).drop(html)


def slug(title: Column) -> Column:
    """A file name of a title: its letters and digits, at most 60 characters, and a digest; the digest alone if it has none."""
    digest = F.substring(F.md5(title.cast("binary")), 1, 8)
    safe = F.substring(F.regexp_replace(F.regexp_replace(title, r"[^A-Za-z0-9]+", "_"), "^_+|_+$", ""), 1, 60)
    return F.when(safe == "", digest).otherwise(F.concat(safe, F.lit("_"), digest))


def model_slug(name: Column) -> Column:
    """A model's name in lower case with one dash for whatever stands between letters and digits of any script."""
    safe = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(safe == "", "model").otherwise(safe)


def html_escaped(text: Column) -> Column:
    out = text
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def highlighted(text: Column, answer: Column) -> Column:
    """HTML-escaped text with the answer marked, whatever its case and whatever white space is where it has some."""
    quoted = F.regexp_replace(html_escaped(answer), r"([\\.\[\]{}()*+?^$|\-&#])", r"\\$1")
    pattern = F.concat(F.lit("(?iu)("), F.regexp_replace(quoted, r"(?U)\s+", r"(?U:\\s+)"), F.lit(")"))
    return F.when(F.length(answer) > 0, F.regexp_replace(html_escaped(text), pattern, F.lit("<mark>$1</mark>"))).otherwise(html_escaped(text))


def fixed_number(value: Column, places: int) -> Column:
    """A number with so many places, as result files have it; empty for null and NaN."""
    known = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return F.when(known.isNull(), "").otherwise(F.format_string(f"%.{places}f", known))


def checked_query(text: Column, most: int = 2000) -> Column:
    """A stripped query; null counts as empty, one longer than `most` before stripping fails the job."""
    value = F.coalesce(text, F.lit(""))
    too_long = F.raise_error(F.lit(f"a query may have {most} characters at most")).cast("string")
    return F.when(F.length(value) > most, too_long).otherwise(strip(value))


#: What prompts begin with, with passages and without.
WITH_PASSAGES = "Answer the question using the passages below. Reply with the answer only, as a short phrase, without explanation."
CLOSED_BOOK = "Answer the question. Reply with the answer only, as a short phrase, without explanation."
#: What goes before a question for an embedding model whose name holds one of these.
QUERY_PREFIX, PREFIXED_MODELS = "Represent this sentence for searching relevant passages: ", ("bge-", "/bge")


def prompt(question: Column, passages: Column) -> Column:
    """The instruction, numbered passages (title, text) and the question; without passages (null) the closed-book form."""
    blocks = F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p["title"], F.lit("\n"), p["text"]))
    asked = F.concat(F.lit("Question: "), question)
    return F.when(passages.isNull(), F.concat_ws("\n\n", F.lit(CLOSED_BOOK), asked)).otherwise(F.concat_ws("\n\n", F.lit(WITH_PASSAGES), F.array_join(blocks, "\n\n"), asked))


def encoder_input(text: Column, model: str, is_query: bool) -> Column:
    """What an embedding model is given: queries of models of one family carry an instruction."""
    return F.concat(F.lit(QUERY_PREFIX), text) if is_query and any(m in model.lower() for m in PREFIXED_MODELS) else text


def built_prompt(question: Column, passages: Column, most: int) -> Column:
    """(text, n_cut): the prompt of passages cut to `most` tokens each, and how many were cut."""
    cut = F.transform(passages, lambda p: F.struct(p["title"].alias("title"), cut_passage(p["text"], most).alias("c")))
    return bound(
        F.struct(cut.alias("cut")),
        lambda x: F.struct(
            prompt(question, F.transform(x["cut"], lambda p: F.struct(p["title"].alias("title"), p["c"]["text"].alias("text")))).alias("text"),
            F.coalesce(F.size(F.filter(x["cut"], lambda p: p["c"]["cut"])), F.lit(0)).alias("n_cut"),
        ),
    )


def answer_in_prompt(passages: Column, answer: Column, gold: Column) -> Column:
    """Whether a passage of a gold title still holds the answer; null without passages."""
    return F.when(passages.isNotNull(), F.exists(passages, lambda p: F.array_contains(gold, p["title"]) & F.contains(normalize_text(p["text"]), normalize_text(answer))))


def cut_passage(text: Column, most: int) -> Column:
    """(text, cut): the first `most` white-space tokens; a text that fits stays as it is."""
    return bound(
        F.filter(F.split(text, r"\s+"), lambda x: x != ""),
        lambda tokens: F.struct(F.when(F.size(tokens) <= most, text).otherwise(F.array_join(F.slice(tokens, 1, most), " ")).alias("text"), (F.size(tokens) > most).alias("cut")),
    )
