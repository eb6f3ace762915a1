"""Text rules as Column expressions. All stay in the JVM; none needs a Python function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and patterns that decide tokens.
# The classes spell out Unicode, since the JVM's short forms are ASCII only.
WS = r"[\p{Z}\x09-\x0d\x1c-\x1f\x{85}]"
NOT_WS = r"[^\p{Z}\x09-\x0d\x1c-\x1f\x{85}]"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"[\p{L}\p{N}_]"
DIGITS = r"\p{Nd}+"
CHAR_DOMAINS = "com|co\\.kr|kr|ly|gl|net|org"
WORD_DOMAINS = "com|co\\.kr|kr|ly|gl|net|org|io"
EN_WORD = "[a-z']+"
HANGUL = "[가-힣]"
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"
URL_TOKEN = "<url>"
NUM_TOKEN = "<num>"
ATTACHMENT_WORD = "첨부파일"
SUBJECT_TAG = "제목: "
SENDER_TAG = "발신: "
ATTACHMENT_TAG = "첨부: "
NO_SENDER = "(발신자 없음)"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _capped(col: Column, cap: int | None) -> Column:
    return col if cap is None else F.substring(col, 1, cap)


def strip(col: Column | str) -> Column:
    """Drop leading and trailing whitespace of every Unicode kind."""
    return F.trim(_c(col), F.lit(WS_CHARS))


def collapse(col: Column | str) -> Column:
    """Each run of whitespace becomes one space, then strip."""
    return F.trim(F.regexp_replace(_c(col), f"{WS}+", " "))


def has_hangul(col: Column | str) -> Column:
    return F.coalesce(_c(col).rlike(HANGUL), F.lit(False))


def detect_lang(col: Column | str) -> Column:
    """'ko' when any Hangul syllable occurs, else 'en'; null counts as 'en'."""
    return F.when(has_hangul(col), "ko").otherwise("en")


def route_lang(subject: Column | str, body: Column | str) -> Column:
    """Routing looks at subject and body only."""
    return detect_lang(F.concat_ws(" ", _c(subject), _c(body)))


def _field(col: Column) -> Column:
    s = strip(col)
    # No longer text is lower-cased just to be told from three letters.
    return F.when((s != "") & ((F.length(s) > 3) | (F.lower(s) != "nan")), s)


def compose_email(
    subject: Column | str, sender: Column | str, body: Column | str, attachment: Column | str
) -> Column:
    """Model input: the non-blank fields joined by a space, attachment named last."""
    return F.concat_ws(
        " ",
        _field(_c(subject)),
        _field(_c(sender)),
        _field(_c(body)),
        F.concat(F.lit(ATTACHMENT_WORD + " "), _field(_c(attachment))),
    )


def compose_content(
    subject: Column | str,
    sender: Column | str,
    body: Column | str,
    attachment: Column | str,
    cap: int | None = None,
) -> Column:
    """Stored form of a hand-entered mail: labelled lines, body always present; whole unless ``cap`` is given."""

    def tagged(tag: str, col: Column | str) -> Column:
        s = strip(col)
        return F.when(s != "", F.concat(F.lit(tag), s))

    lines = F.concat_ws(
        "\n",
        tagged(SUBJECT_TAG, subject),
        tagged(SENDER_TAG, sender),
        F.coalesce(strip(body), F.lit("")),
        tagged(ATTACHMENT_TAG, attachment),
    )
    return _capped(lines, cap)


def mail_content(subject: Column | str, body: Column | str, cap: int | None = None) -> Column:
    """Stored form of a fetched mail: subject and body, stripped; whole unless ``cap`` is given."""
    joined = F.concat(
        F.coalesce(_c(subject), F.lit("")), F.lit(" "), F.coalesce(_c(body), F.lit(""))
    )
    return _capped(strip(joined), cap)


def _marked(col: Column | str, domains: str) -> Column:
    # Possessive runs and the look-behind keep the scan linear on long unbroken text.
    url = f"https?://{NOT_WS}++|(?<!{WORD}){WORD}++\\.(?:{domains}){NOT_WS}*+"
    text = F.lower(_c(col))

    def linked(part: Column) -> Column:
        return part.contains("://") | part.rlike(f"\\.(?:{domains})")

    # Lines without any part that every link has are spared the scan for whole links; none goes past a line's end.
    lines = F.transform(
        F.split(text, "\n"),
        lambda line: F.when(linked(line), F.regexp_replace(line, url, f" {URL_TOKEN} ")).otherwise(line),
    )
    text = F.when(linked(text), F.array_join(lines, "\n")).otherwise(text)
    return F.regexp_replace(text, DIGITS, f" {NUM_TOKEN} ")


def marked_chars(col: Column | str) -> Column:
    """The text that ``char_tokens`` takes apart: lower case, links and numbers as chunks of their own."""
    return _marked(col, CHAR_DOMAINS)


def marked_words(col: Column | str) -> Column:
    """As ``marked_chars``, the text that ``word_tokens`` takes apart."""
    return _marked(col, WORD_DOMAINS)


def _first_chars(col: Column | str, n: int) -> Column:
    """As much of a text, marked, as holds its first ``n`` character tokens.

    Every chunk between whitespace has a token, and links and numbers lie within a chunk: only the first
    ``n`` chunks are marked. Five more characters tell a marker from a longer chunk that begins like one.
    """
    head = F.regexp_extract(F.lower(_c(col)), f"^(?:{WS}*+{NOT_WS}++){{0,{n}}}+", 0)
    token = f"[^<{WS[1:-1]}]|(?<!{NOT_WS})(?:{URL_TOKEN}|{NUM_TOKEN})(?!{NOT_WS})|<"
    return F.regexp_extract(marked_chars(head), f"^(?:{WS}*+(?:{token})){{0,{n}}}+{NOT_WS}{{0,5}}+", 0)


def char_tokens(col: Column | str, first: int | None = None) -> Column:
    """Korean tokens: one per character, links and numbers as markers; with ``first`` so many of them."""
    marked = marked_chars(col) if first is None else _first_chars(col, first)
    chunks = F.filter(F.split(marked, f"{WS}+"), lambda c: c != "")
    found = F.flatten(
        F.transform(
            chunks,
            lambda c: F.when(c.isin(URL_TOKEN, NUM_TOKEN), F.array(c)).otherwise(F.split(c, "")),
        )
    )
    return found if first is None else F.slice(found, 1, first)


def word_tokens(col: Column | str) -> Column:
    """English tokens: runs of a-z and apostrophe, links and numbers as markers.

    A marker counts only as a whole whitespace-delimited chunk.
    """
    # Words first, and a look for "<" before the look-behind: no place fits both, and most hold neither.
    marker = f"(?=<)(?<!{NOT_WS})(?:{URL_TOKEN}|{NUM_TOKEN})(?!{NOT_WS})"
    return F.regexp_extract_all(marked_words(col), F.lit(f"{EN_WORD}|{marker}"), F.lit(0))


def tokens(col: Column | str, lang: str) -> Column:
    return char_tokens(col) if lang == "ko" else word_tokens(col)


def extract_email(sender: Column | str) -> Column:
    """Lower-cased address inside a display string; else the stripped lower string; null is ''."""
    s = _c(sender)
    return F.coalesce(F.lower(F.coalesce(F.regexp_substr(s, F.lit(EMAIL)), strip(s))), F.lit(""))


def email_domain(email: Column | str) -> Column:
    """Text after the last '@', or '' when there is none."""
    e = _c(email)
    return F.when(e.contains("@"), F.substring_index(e, "@", -1)).otherwise(F.lit(""))


def preview(content: Column | str, limit: int) -> Column:
    """One-line preview: breaks and tabs to spaces, strip, drop the subject tag, cut with an ellipsis."""
    text = strip(F.regexp_replace(_c(content), "\r\n|[\r\n\t]", " "))
    text = F.when(
        text.startswith(SUBJECT_TAG), F.substring(text, len(SUBJECT_TAG) + 1, 2**31 - 1)
    ).otherwise(text)
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))
    ).otherwise(text)


def percent(prob: Column | str) -> Column:
    """Whole percent; an exact half rounds to even."""
    return F.concat(F.bround(_c(prob) * 100, 0).cast("int").cast("string"), F.lit("%"))
