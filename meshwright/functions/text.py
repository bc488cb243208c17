"""Text functions as Column expressions."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _decompositions() -> tuple[str, str, str]:
    """What compatibility decomposition leaves in ASCII, by Unicode's own rule and not by a table.

    Characters that leave one character and these characters; and a JSON object of those that leave several.
    """
    one, several = {}, {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x30000))):
        left = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if left:
            (one if len(left) == 1 else several)[c] = left
    return "".join(one), "".join(one.values()), json.dumps(several, ensure_ascii=False)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that a plan holds, and Spark evaluates, once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def ascii_only(text: Column) -> Column:
    """Accents off, ligatures and other compatible forms spelt out, what then isn't ASCII dropped (as NFKD and an ASCII encoding do).

    Texts without characters that leave several (ligatures, fractions) need one translation; others are taken apart.
    """
    one, ascii_, several = _decompositions()
    listed = "".join(json.loads(several))
    plain = F.regexp_replace(F.translate(text, one, ascii_), f"[^\\x00-\\x7F{listed}]", "")
    spelt = F.from_json(F.lit(several), "map<string,string>")
    letters = lambda p: F.regexp_extract_all(p, F.lit("(?s)(.)"), F.lit(1))
    each = lambda p: F.array_join(F.transform(letters(p), lambda c: F.coalesce(F.try_element_at(spelt, c), c)), "")
    return _once(plain, lambda p: F.when(p.rlike(f"[{listed}]"), each(p)).otherwise(p))


#: Every character that Unicode calls white space, and the four separators of ASCII that Python takes for it too.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def stripped(text: Column) -> Column:
    """Without white space outside."""
    return F.btrim(text, F.lit(SPACES))


def slug(name: Column, empty: str = "sin-nombre") -> Column:
    """Lower-case ASCII words joined by hyphens; `empty` where nothing is left."""
    words = F.regexp_replace(F.lower(ascii_only(F.coalesce(name, F.lit("")))), "[^a-z0-9]+", "-")
    return _once(F.regexp_replace(words, "^-+|-+$", ""), lambda found: F.when(found == "", F.lit(empty)).otherwise(found))


def normal_name(name: Column) -> Column:
    """Upper-case ASCII without outer white space."""
    return stripped(F.upper(ascii_only(name)))


def title_case(text: Column) -> Column:
    """Each run of letters with a capital first and small letters after."""
    runs = F.regexp_extract_all(text, F.lit("(\\p{L}+|\\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def clean_tag(tag: Column) -> Column:
    """Lower case without white space outside; null as empty."""
    return F.lower(stripped(F.coalesce(tag, F.lit(""))))


def squeeze(text: Column) -> Column:
    """Each run of white space, of any kind that Unicode knows, as one space; none outside."""
    return F.btrim(F.regexp_replace(text, f"[{SPACES}]+", " "))


#: Patterns of contact data (word characters are Unicode's).
E_MAIL = r"(?iU)[\w.+-]+@[\w-]+\.[\w.-]+"
TELEPHONE = r"(?U)(?<!\w)\+?(?:56)?[\s.\-]?(?:9|2)?[\s.\-]?\d{4}[\s.\-]?\d{4}(?!\w)"


def anonymise(text: Column) -> Column:
    """E-mail addresses as [correo], then telephone numbers as [telefono]; null stays null."""
    return F.regexp_replace(F.regexp_replace(text, E_MAIL, "[correo]"), TELEPHONE, "[telefono]")


def padded(number: Column, width: int = 6) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def xml_escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def place_category(columns: dict[str, Column]) -> Column:
    """The first non-empty of these keys as key=value, else sin_categoria."""
    keys = ("amenity", "shop", "leisure", "tourism", "healthcare", "office")
    found = [F.concat(F.lit(f"{k}="), F.nullif(columns[k], F.lit(""))) for k in keys if k in columns]
    return F.coalesce(*found, F.lit("sin_categoria"))
