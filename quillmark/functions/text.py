"""Text primitives and normalization, all as Columns that Spark compiles or evaluates in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns that results depend on.
WORD = r"[^\x20\x09-\x0D]+"
SENTENCE_END = r"[.!?]+"
SENTENCE_CUT = r"(?<!\b[A-Z])[.!?۔؟。]+(?=\s+[A-Z0-9\"'])"
EMAIL = r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"
PHONE = r"(?:\+?\d[\s\-\.)/]*)?(?:\(?\d{3}\)?[\s\-\./]*)?\d{3}[\s\-\./]*\d{4}"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PII = (
    r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b",
    r"\b(?:\+?\d{1,3})?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
)
#: What UTF-8 read as Latin-1 makes of a sign, and the sign.
LATIN_SIGNS = (
    ("Â·", "·"), ("Â¢", "¢"), ("Â£", "£"), ("Â¥", "¥"), ("Â§", "§"), ("Â©", "©"), ("Â®", "®"), ("Â°", "°"), ("Â±", "±"), ("Â²", "²"), ("Â³", "³"),
    ("Â´", "´"), ("Âµ", "µ"), ("Â¶", "¶"), ("Â¹", "¹"), ("Âº", "º"), ("Â»", "»"), ("Â¼", "¼"), ("Â½", "½"), ("Â¾", "¾"), ("Â¿", "¿"),
)
#: Other sequences of that kind and what they stand for, in the order of their repair.
MOJIBAKE = (
    ("Â ", " "), (" ", " "), ('â€"', "—"), ("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("â€˜", "'"), ("â€¦", "..."),
    ("Ã¡", "á"), ("Ã©", "é"), ("Ã­", "í"), ("Ã³", "ó"), ("Ãº", "ú"), ("Ã±", "ñ"), ("Ã", "à"),
)
TYPOS = (("teh", "the"), ("adn", "and"), ("tha", "that"), ("taht", "that"), ("hte", "the"))


def text_of(c: str | Column) -> Column:
    """A text that is never null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it: as the variable of a function over an array of one. A column that is used
    inside of a lambda may else be put there by the optimiser and computed again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repeats(values: Column, least: int) -> Column:
    """For each value of an array, in its order: whether it occurs `least` times or more and has occurred before. Null values don't repeat.

    Values are sorted with their places: one repeats if its neighbour in front is equal, and it is in a large group if some `least` neighbours around
    it are equal. So it takes a sort, and no value is compared with all others.
    """
    def near(q: Column, j: Column, v: Column, by: int) -> Column:
        return (j + by >= 0) & F.coalesce(F.get(q, j + by)["v"] == v, F.lit(False))

    def mark(q: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            groups = F.lit(False)
            for k in range(least):
                groups = groups | (near(q, j, x["v"], -k) & near(q, j, x["v"], least - 1 - k))
            return F.struct(x["i"].alias("i"), (near(q, j, x["v"], -1) & groups).alias("r"))

        return F.transform(F.array_sort(F.transform(q, one)), lambda x: x["r"])

    return let(F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), mark)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("int")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def squeezed(c: Column) -> Column:
    """Words joined by single spaces."""
    return F.array_join(words(c), " ")


def sentences(c: Column) -> Column:
    """Non-empty parts between runs of . ! and ?"""
    return F.filter(F.transform(F.split(c, SENTENCE_END), stripped), lambda s: s != "")


def token_estimate(c: Column) -> Column:
    """Words * 1.3, rounded down."""
    return F.floor(n_words(c) * 1.3).cast("int")


def chunk_tokens(c: Column) -> Column:
    """What the chunkers count: a quarter of the characters, or the words if they are more."""
    return F.greatest(F.floor(F.length(c) / 4), n_words(c).cast("bigint")).cast("int")


def has_pii(c: Column) -> Column:
    """The patterns for numbers need six digits and the one for addresses an @, which is much cheaper to look for."""
    numbers = F.rlike(c, F.lit(r"\d\d[-.\s]?\d{4}")) & (F.rlike(c, F.lit(PII[0])) | F.rlike(c, F.lit(PII[1])))
    return numbers | (F.contains(c, F.lit("@")) & F.rlike(c, F.lit(PII[2])))


def redact(c: Column) -> Column:
    """E-mail addresses, then phone numbers, then social security numbers."""
    for pattern, mark in ((EMAIL, "[redacted_email]"), (PHONE, "[redacted_phone]"), (SSN, "[SSN]")):
        c = F.regexp_replace(c, pattern, mark)
    return c


def unwrap_lines(c: Column) -> Column:
    """Hyphenated and hard-wrapped lines are joined: a line that starts in lower case goes on from one that doesn't end a sentence."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\r", "\n")
    c = F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"(?m)^[ \t]+|[ \t]+$", "")
    c = F.regexp_replace(c, r"(?<![.!?][\"')\]]{0,20})(?<!\n)\n(?=[a-z])", " ")
    return stripped(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def clean_spaces(c: Column) -> Column:
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"(?m)^ +| +$", "")
    return stripped(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def repair_encoding(c: Column) -> Column:
    for bad, good in (*LATIN_SIGNS, *MOJIBAKE):
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def collapse_doubled(c: Column) -> Column:
    """A word that follows itself without a space is kept once."""
    return F.regexp_replace(c, r"(?i)\b([a-zA-Z]{2,})\1+\b", "$1")


def looks_spaced_out(c: Column, probe: int = 500) -> Column:
    """More than 30 % spaces near the start of a text of over 100 characters: letters were set apart in extraction."""
    head = F.substring(c, 1, probe)
    return (F.length(c) > 100) & ((F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))) / F.length(head) > 0.3)


def normalize(c: Column) -> Column:
    """All repairs in order; a spaced-out text is left alone."""
    out = collapse_doubled(clean_spaces(repair_encoding(c)))
    for pattern, to in (
        (r"[\x00-\x08\x0B-\x0C\x0E-\x1F]", ""), (r" +([,.!?;:])", "$1"), (r"([,.!?;:])([^\s])", "$1 $2"),
        (r"[‘’′]", "'"), (r"[“”″]", '"'), (r"[–—―]", "-"), (r"\.{4,}", "..."),
    ):
        out = F.regexp_replace(out, pattern, to)
    return F.when(looks_spaced_out(c), c).otherwise(stripped(out))


def correct(c: Column) -> Column:
    """Common slips of recognition, letters repeated four times or more, and a missing space after a sentence."""
    out = c
    for bad, good in TYPOS:
        out = F.regexp_replace(out, rf"(?i)\b{bad}\b", good)
    out = F.regexp_replace(out, r"(?i)([a-z])\1{3,}", "$1$1")
    out = F.regexp_replace(out, r"(?i)([.!?])([A-Z][a-z])", "$1 $2")
    return F.when(looks_spaced_out(c), c).otherwise(out)


def close_letters(c: Column) -> Column:
    """Ten passes that join single letters or digits set apart by spaces, for spaced-out texts only."""
    out = c
    for _ in range(10):
        out = F.regexp_replace(out, r"([A-Za-z0-9]) ([A-Za-z0-9])", "$1$2")
    return F.when(looks_spaced_out(c, 1000), out).otherwise(c)


def apply_steps(c: Column, steps: Iterable[dict]) -> Column:
    """A playbook's replacements {pattern, replace, flags} in order; a list pattern is a set of characters, \\1 means a group."""
    for step in steps:
        pattern = step.get("pattern")
        if not pattern:
            continue
        if isinstance(pattern, list):
            pattern = "[" + "".join(map(str, pattern)) + "]"
        flags = "".join({"MULTILINE": "m", "IGNORECASE": "i"}.get(f.strip().upper(), "") for f in (step.get("flags") or "").split("|"))
        to = step.get("replace", "").replace("$", r"\$")
        for g in range(1, 10):
            to = to.replace(f"\\{g}", f"${g}")
        c = F.regexp_replace(c, (f"(?{flags})" if flags else "") + pattern, to)
    return c


def noise_score(c: Column, repetition: Column) -> Column:
    """1 for clean, 0 for noisy text, from repetition and from characters that prose seldom has."""
    odd = F.length(F.regexp_replace(c, r"[\p{L}\p{N}\s.,;:!?\-'\"()\[\]/\\@#%&*]", "")) / F.length(c)
    penalty = F.least(F.lit(1.0), repetition * 2) * 0.6 + F.least(F.lit(1.0), odd * 5) * 0.4
    return F.when(F.length(c) < 10, 1.0).otherwise(clip(1 - penalty))


def clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def estimate_quality(c: Column) -> Column:
    """A quick 0 to 100 by spaces, slips, length, capitals and sentence ends."""
    n = F.length(c)
    head = F.substring(c, 1, 500)
    spaces = (F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))) / F.length(head)
    slips = F.regexp_count(c, F.lit(r"(?i)\b(?:teh|adn|hte|tha|taht)\b"))
    q = 80 - spaces * 100 - slips / F.greatest(n_words(c), F.lit(1)) * 20
    q = q - F.when(n < 50, 10).otherwise(0) - F.when(F.rlike(c, F.lit(r"\p{Lu}")), 0).otherwise(5) - F.when(F.rlike(c, F.lit("[.!?]")), 0).otherwise(5)
    return F.when(stripped(c) == "", 0.0).when((n > 100) & (spaces > 0.3), 40.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), q)))


def low_quality(c: Column) -> Column:
    """Too short, one word over 30 % of more than ten, or under half letters."""
    w = words(c)
    letters = F.length(F.regexp_replace(c, r"\P{L}", ""))
    return (F.length(c) < 50) | ((F.size(w) > 10) & (top_share(c) > 0.3)) | (letters < F.length(c) * 0.5)


def top_share(c: Column) -> Column:
    """Share of the most frequent word: the longest run once the words are sorted, found in one pass."""
    runs = F.aggregate(
        F.sort_array(words(c)), F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("m")),
        lambda a, w: F.struct(w.alias("w"), F.when(a["w"] == w, a["n"] + 1).otherwise(1).alias("n"), F.greatest(a["m"], F.when(a["w"] == w, a["n"] + 1).otherwise(1)).alias("m")),
    )
    return runs["m"] / F.greatest(n_words(c), F.lit(1))


def quality_controlled(c: Column, least: int = 50, most: int = 2000) -> Column:
    """Control characters go, then too short and low-quality texts become null, long ones are cut, spaces squeezed."""
    out = F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F]", "")
    cut = F.substring(out, 1, most)
    return F.when((F.length(out) >= least) & ~low_quality(cut), squeezed(cut))


def representative_sample(c: Column, chunk: int = 5000, most: int = 20000) -> Column:
    """A text within `most` characters whole, a longer one as head, middle and tail."""
    t = squeezed(c)
    n = F.length(t)
    part = min(chunk, most // 3)
    start = F.greatest(F.lit(0), F.floor(n / 2).cast("int") - part // 2)
    start = F.when(start + part > n, F.greatest(F.lit(0), n - part)).otherwise(start)
    parts = F.concat(F.substring(t, 1, part), F.lit(" === MIDDLE SAMPLE === "), F.substring(t, start + 1, F.lit(part)), F.lit(" === END SAMPLE === "), F.substring(t, -part, part))
    return F.when(n <= most, t).otherwise(F.substring(parts, 1, most))


def extraction_type(c: Column, filename: Column) -> Column:
    """digital_pdf, scanned_pdf or mixed, by characters per page."""
    actual = stripped(F.replace(F.replace(c, F.lit("=== PAGE"), F.lit("")), F.lit("==="), F.lit("")))
    pages = F.greatest(F.regexp_count(c, F.lit("=== PAGE")), F.lit(1))
    parts = F.filter(F.transform(F.split(c, "=== PAGE"), stripped), lambda p: p != "")
    tiny = F.size(F.filter(parts, lambda p: F.length(stripped(F.replace(p, F.lit("==="), F.lit("")))) < 100))
    mixed = F.contains(c, F.lit("=== PAGE")) & (F.size(parts) >= 2) & (tiny > 0) & (tiny < F.size(parts))
    scanned = (F.length(actual) < 500) | (F.length(actual) / pages < 50)
    pdf = F.endswith(F.lower(filename), F.lit(".pdf"))
    return F.when(~pdf | (c == ""), "digital_pdf").when(scanned, "scanned_pdf").when(mixed, "mixed").otherwise("digital_pdf")


def ends_mid_sentence(c: Column) -> Column:
    """No sentence end, and no word behind or under twenty characters."""
    t = stripped(c)
    return ~F.rlike(t, F.lit(r"[.!?]['\")\]]*$")) & (~F.rlike(t, F.lit(r"\w$")) | (F.length(t) < 20))


def first_sentence(c: Column, most: int = 300, otherwise: int = 250) -> Column:
    """Up to the first '. ', else '? ', else '! ' within 300 characters; else the first 250."""
    t = stripped(c)
    at = [F.instr(t, F.lit(m)) for m in (". ", "? ", "! ")]
    out = F.substring(t, 1, otherwise)
    for p in reversed(at):
        out = F.when((p > 0) & (p <= most), F.substring(t, F.lit(1), p)).otherwise(out)
    return out


def found_dates(c: Column, most: int = 3) -> Column:
    """The first few dates in a text, day, month or year first."""
    return F.slice(F.regexp_extract_all(c, F.lit(r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b"), F.lit(0)), 1, most)


def metadata(c: Column) -> Column:
    """struct(doc_date, dates, author, versions): of each form of date the first three, the first of all of them, an author behind "By:" or the like, two version numbers.

    Of dates with a month's name only the name is given, and of numbers with v in front only the numbers."""
    # Letters, digits and spaces are ASCII ones, so a word may start behind an accented letter; of others only the two signs that stand for s and k in any case are letters.
    start, end, space, letter = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])", r"[\t\n\f\r ]", r"[A-Za-z\u017F\u212A]"
    find = lambda p, g, n: F.slice(F.regexp_extract_all(c, F.lit("(?i)" + p), F.lit(g)), 1, n)
    months = r"January|February|March|April|May|June|July|Augu[s\u017F]t|[s\u017F]eptember|October|November|December"
    dates = F.concat(
        find(rf"{start}(\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}){end}", 1, 3), find(rf"{start}({months}){space}+\d{{1,2}},?{space}+\d{{4}}{end}", 1, 3), find(rf"{start}\d{{4}}-\d{{2}}-\d{{2}}{end}", 0, 3)
    )
    author = F.get(find(rf"(?:By|Author|Written by|Created by):{space}*({letter}{letter}+(?:{space}+{letter}{letter}+)+)", 1, 1), F.lit(0))
    versions = find(rf"{start}(v|ver[s\u017F]ion|ver|v\.){space}*(\d+(?:\.\d+)+){end}", 2, 2)
    return F.struct(F.get(dates, F.lit(0)).alias("doc_date"), F.slice(dates, 1, 3).alias("dates"), author.alias("author"), versions.alias("versions"))


#: Fixed styles of questions: least characters and words of a sentence (more than), words that make a key term in any case, the question with and without one.
STYLES = {
    "technical": (20, 5, ("api", "sdk", "cli", "config"), "What is {}?", "How does {} work?", 0),
    "academic": (30, 8, (), "What are the findings on {}?", "What does the research show about {}?", 3),
    "clinical": (25, 6, ("patient", "diagnosis", "treatment", "medication", "dose"), "What is the {}?", "What are the clinical indications?", None),
    "general": (20, 5, (), "What is {}?", "What is {}?", 0),
}


def questions(c: Column, style: str = "technical", n: int = 3, least: int = 10, most: int = 50) -> Column:
    """Up to n questions from the first n sentences (between full stops) that are long enough, of `least` to `most` characters; none for texts under 50.

    Technical and academic ones ask for the first word with a capital, clinical ones for the first medical word; without such a word they ask for the sentence's first word or fourth word."""
    chars, count, terms, named, plain, place = STYLES.get(style, STYLES["general"])
    parts = F.slice(F.filter(F.transform(F.split(c, r"\."), stripped), lambda s: F.length(s) > chars), 1, n)

    def ask(s: Column) -> Column:
        def of(w: Column) -> Column:
            capital = lambda x: F.rlike(x, F.lit(r"^\p{Lu}")) if style in ("technical", "academic") else F.lit(False)
            key = F.get(F.filter(w, lambda x: capital(x) | F.lower(x).isin(*terms)) if terms else F.filter(w, capital), F.lit(0))
            fill = lambda form, v: F.concat(F.lit(form.split("{}")[0]), v, F.lit(form.split("{}")[1])) if "{}" in form else F.lit(form)
            other = fill(plain, F.get(w, F.lit(place or 0)))
            return F.when(F.size(w) > count, F.when(key.isNotNull(), fill(named, key)).otherwise(other))

        return let(words(s), of)

    every = F.filter(F.transform(parts, ask), lambda q: q.isNotNull() & F.length(q).between(least, most))
    return F.when(F.length(stripped(c)) >= 50, every).otherwise(F.array().cast("array<string>"))


#: Fixed prices of a thousand tokens in and out.
MODEL_PRICES = (0.00015, 0.0006)


def enhancement_cost(n_chars: Column, mode: Column, good: Column) -> Column:
    """Cost of a model's pass over a text of so many characters: none in mode pattern, nor in mode hybrid where the text is good already."""
    return F.when((mode == "pattern") | ((mode == "hybrid") & good), 0.0).otherwise(n_chars / 4.0 / 1000 * sum(MODEL_PRICES))
