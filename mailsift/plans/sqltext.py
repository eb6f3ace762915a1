"""SQL wording of the text rules, for checking in a second engine.

That engine's regular expressions have no look-around, so tokens are cut there by splitting on
whitespace first.
"""

from __future__ import annotations

from mailsift.functions.text import (
    CHAR_DOMAINS,
    DIGITS,
    EMAIL,
    EN_WORD,
    HANGUL,
    NOT_WS,
    WORD,
    WORD_DOMAINS,
    WS,
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^{WS}+|{WS}+$')}, '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, {lit(WS + '+')}, ' ', 'g')")


def _marked(x: str, domains: str) -> str:
    url = lit(f"https?://{NOT_WS}+|{WORD}+\\.(?:{domains}){NOT_WS}*")
    return (
        f"regexp_replace(regexp_replace(lower({x}), {url}, ' <url> ', 'g'), {lit(DIGITS)}, ' <num> ', 'g')"
    )


def tokens(x: str, lang: str) -> str:
    domains, unit = (CHAR_DOMAINS, "(?s).") if lang == "ko" else (WORD_DOMAINS, EN_WORD)
    chunks = f"list_filter(string_split_regex({_marked(x, domains)}, {lit(WS + '+')}), lambda z: z <> '')"
    return (
        f"flatten(list_transform({chunks}, lambda z: CASE WHEN z IN ('<url>', '<num>') "
        f"THEN [z] ELSE regexp_extract_all(z, {lit(unit)}) END))"
    )


def lang_of(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {lit(HANGUL)}) THEN 'ko' ELSE 'en' END"


def email(x: str) -> str:
    found = f"regexp_extract({x}, {lit('(' + EMAIL + ')')}, 1)"
    return f"COALESCE(lower(CASE WHEN {found} <> '' THEN {found} ELSE {strip(x)} END), '')"


def domain(e: str) -> str:
    return f"CASE WHEN contains({e}, '@') THEN list_extract(string_split({e}, '@'), -1) ELSE '' END"


def _field(x: str) -> str:
    s = strip(x)
    return f"CASE WHEN {s} <> '' AND lower({s}) <> 'nan' THEN {s} END"


def compose_email(subject: str, sender: str, body: str, attachment: str) -> str:
    return (
        f"concat_ws(' ', {_field(subject)}, {_field(sender)}, {_field(body)}, "
        f"'첨부파일 ' || ({_field(attachment)}))"
    )


def compose_content(subject: str, sender: str, body: str, attachment: str) -> str:
    def tagged(tag: str, x: str) -> str:
        return f"CASE WHEN {strip(x)} <> '' THEN '{tag}' || {strip(x)} END"

    return (
        f"concat_ws(chr(10), {tagged('제목: ', subject)}, {tagged('발신: ', sender)}, "
        f"COALESCE({strip(body)}, ''), {tagged('첨부: ', attachment)})"
    )


def mail_content(subject: str, body: str) -> str:
    joined = f"(COALESCE({subject}, '') || ' ' || COALESCE({body}, ''))"
    return strip(joined)


def preview(x: str, limit: int) -> str:
    text = strip(f"regexp_replace({x}, {lit(chr(13) + chr(10) + '|[' + chr(13) + chr(10) + chr(9) + ']')}, ' ', 'g')")
    text = f"CASE WHEN starts_with({text}, '제목: ') THEN substring({text}, 5) ELSE {text} END"
    return (
        f"CASE WHEN length({text}) > {limit} THEN substring({text}, 1, {limit}) || '…' ELSE {text} END"
    )


def tier(p: str) -> str:
    return f"CASE WHEN {p} >= 0.7 THEN 'spam' WHEN {p} < 0.4 THEN 'ham' ELSE 'review' END"


def seeded(*parts: str) -> str:
    return "md5(concat_ws('|', '42', " + ", ".join(parts) + "))"


def number(h: str, n: str) -> str:
    return f"(CAST('0x' || substring({h}, 1, 8) AS BIGINT) % {n})"
