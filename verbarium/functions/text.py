"""Text functions as Column expressions."""

from __future__ import annotations

import html
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _fold_map() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters whose compatibility decomposition keeps one ASCII character, those
    characters, and pairs for what keeps several. Composed scripts without any are left
    out, as what isn't ASCII goes anyway."""
    one, many = [], []
    for code in [*range(0x80, 0x2E80), *range(0x3000, 0x3400), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]:
        if 0xD800 <= code < 0xE000:
            continue
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one.append((chr(code), plain))
        elif plain:
            many.append((chr(code), plain))
    return "".join(a for a, _ in one), "".join(b for _, b in one), many


FOLD_FROM, FOLD_TO, FOLD_MANY = _fold_map()
_BEYOND = r"[^\x00-\x7F]"
#: Where characters of FOLD_MANY may be, quickly and exactly.
_FAR = r"[\u00BC-\u00BE\u0132-\x{10FFFF}]"


def _ranges(chars: list[str]) -> str:
    out: list[list[int]] = []
    for code in map(ord, chars):
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out) + "]"


_MANY = _ranges([a for a, _ in FOLD_MANY])
WORD = r"[\p{L}\p{N}_]+"

# The Spanish function words that the search analyser drops, still accented.
STOP_WORDS = (
    "a al algo algunas algunos ante antes como con contra cual cuando de del desde donde durante e el ella ellas ellos en entre era erais eran "
    "eras eres es esa esas ese eso esos esta estaba estabais estaban estabas estad estada estadas estado estados estamos estando estar "
    "estaremos estará estarán estarás estaré estaréis estaría estaríais estaríamos estarían estarías estas este estemos esto estos estoy estuve "
    "estuviera estuvierais estuvieran estuvieras estuvieron estuviese estuvieseis estuviesen estuvieses estuvimos estuviste estuvisteis "
    "estuviéramos estuviésemos estuvo está estábamos estáis están estás esté estéis estén estés fue fuera fuerais fueran fueras fueron fuese "
    "fueseis fuesen fueses fui fuimos fuiste fuisteis fuéramos fuésemos ha habida habidas habido habidos habiendo habremos habrá habrán habrás "
    "habré habréis habría habríais habríamos habrían habrías habéis había habíais habíamos habían habías han has hasta hay haya hayamos hayan "
    "hayas hayáis he hemos hube hubiera hubierais hubieran hubieras hubieron hubiese hubieseis hubiesen hubieses hubimos hubiste hubisteis "
    "hubiéramos hubiésemos hubo la las le les lo los me mi mis mucho muchos muy más mí mía mías mío míos nada ni no nos nosotras nosotros "
    "nuestra nuestras nuestro nuestros o os otra otras otro otros para pero poco por porque que quien quienes qué se sea seamos sean seas "
    "seremos será serán serás seré seréis sería seríais seríamos serían serías seáis sido siendo sin sobre sois somos son soy su sus suya suyas "
    "suyo suyos sí también tanto te tendremos tendrá tendrán tendrás tendré tendréis tendría tendríais tendríamos tendrían tendrías tened "
    "tenemos tenga tengamos tengan tengas tengo tengáis tenida tenidas tenido tenidos teniendo tenéis tenía teníais teníamos tenían tenías ti "
    "tiene tienen tienes todo todos tu tus tuve tuviera tuvierais tuvieran tuvieras tuvieron tuviese tuvieseis tuviesen tuvieses tuvimos "
    "tuviste tuvisteis tuviéramos tuviésemos tuvo tuya tuyas tuyo tuyos tú un una uno unos vosotras vosotros vuestra vuestras vuestro vuestros "
    "y ya yo él éramos"
).split()


def fold(c: Column) -> Column:
    """Compatibility decomposition, then every character outside ASCII dropped. Most
    texts have none and stay as they are."""
    pairs = F.from_json(F.lit(json.dumps(dict(FOLD_MANY))), "map<string, string>")
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(_MANY), F.lit(0)))
    wide = F.when(c.rlike(_FAR) & c.rlike(_MANY), F.aggregate(found, c, lambda t, x: F.replace(t, x, F.element_at(pairs, x)))).otherwise(c)
    return F.when(c.rlike(_BEYOND), F.regexp_replace(F.translate(wide, FOLD_FROM, FOLD_TO), _BEYOND, "")).otherwise(c)


@F.pandas_udf(StringType())
def fold_exact(texts: pd.Series) -> pd.Series:
    """C02 by full compatibility decomposition, for text beyond Latin Extended-A."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """Named, decimal and hexadecimal entities."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


def preprocess(c: Column, lowercase: bool = True, remove_accents: bool = True) -> Column:
    """On whole texts, before any splitting."""
    c = F.lower(c) if lowercase else c
    return fold(c) if remove_accents else c


def sentences(c: Column) -> Column:
    """Pieces between line feeds and ``". "``; empty ones stay."""
    return F.flatten(F.transform(F.split(c, "\n"), lambda x: F.split(x, r"\. ")))


def tokens(c: Column) -> Column:
    """Runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def folded_tokens(c: Column) -> Column:
    """C04 of folded text, which is in ASCII, by a plainer pattern."""
    return F.regexp_extract_all(c, F.lit("[0-9A-Za-z_]+"), F.lit(0))


def word_count(c: Column) -> Column:
    """Chunks between white space."""
    return F.coalesce(F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")), F.lit(0)).cast("bigint")


def analyzed(c: Column) -> Column:
    """Tokens, lower-cased, without stop words, folded, in that order. What is left
    is folded in one go."""
    kept = F.filter(tokens(F.lower(c)), lambda x: ~x.isin(STOP_WORDS))
    # one mark ahead, so that no token left and one empty token differ
    return F.slice(F.split(fold(F.array_join(F.array_prepend(kept, F.lit("^")), " ")), " ", -1), 2, 1 << 30)


def document_id(domain: Column | None, source_id: Column) -> Column:
    """C08, and C09 without a domain: thirty hexadecimal digits."""
    key = F.concat_ws("@@", domain, source_id.cast("string")) if domain is not None else source_id.cast("string")
    return F.substring(F.sha2(key, 512), 1, 30)


def join_ids(*parts: Column) -> Column:
    """C10."""
    return F.concat_ws("@@", *[p.cast("string") for p in parts])


def split_ids(c: Column) -> Column:
    return F.split(c, "@@")


def fill_url(template: str, *parts: Column) -> Column:
    """C11: ``{}`` or ``{0}`` places of a URL template, in order."""
    out = F.lit(template)
    for i, part in enumerate(parts):
        text = part.cast("string")
        at = F.instr(out, "{}")
        first = F.when(at > 0, F.concat(F.substring(out, F.lit(1), at - 1), text, F.substring(out, at + 2, F.lit(1 << 30)))).otherwise(out)
        out = F.replace(first, F.lit("{%d}" % i), text)
    return out


def snippet(content: Column, word: Column | None = None, size: int = 100) -> Column:
    """A fragment around the first hit, else the beginning; ``...`` follows a
    beginning of exactly ``size`` characters, cut or not."""
    start = F.substring(content, 1, size)
    plain = F.when(F.length(start) == size, F.concat(start, F.lit("..."))).otherwise(start)
    if word is None:
        return plain
    at = F.position(F.lower(word), F.lower(content))
    return F.when(at > 0, F.substring(content, F.greatest(F.lit(1), at - size // 2), F.lit(size))).otherwise(plain)


def highlighted(content: Column, words: list[str], size: int = 100) -> Column:
    """The fragment of about ``size`` characters that begins with the first of the
    words (as a whole word, case and accents of the content kept), each of them between
    ``<em>`` tags; without a hit, the beginning."""
    if not words:
        return snippet(content, None, size)
    any_of = rf"(?iU)\b({'|'.join(words)})\b"
    found = F.regexp_extract(content, rf"(?isU)(\b(?:{'|'.join(words)})\b.{{0,{size}}})", 1)
    return F.when(found != "", F.regexp_replace(F.substring(found, 1, size), any_of, "<em>$1</em>")).otherwise(snippet(content, None, size))


def title_line(c: Column, most: int | None = 50) -> Column:
    """First line that isn't blank."""
    line = F.split(F.regexp_replace(c, r"\A\s+", ""), "\n")[0]
    return F.substring(line, 1, most) if most else line


def basename(path: Column) -> Column:
    """C14."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def path_year(path: Column) -> Column:
    """C14: the folder that a file lies in."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def numeric_id(link: Column, pattern: str = r"(\d+)") -> Column:
    """C15."""
    return F.regexp_extract(link, pattern, 1).try_cast("bigint")


def story_chapter(link: Column, pattern: str = r"/s/(\d+)/(\d+)") -> Column:
    """Two captures as one id, null without both."""
    story, chapter = F.regexp_extract(link, pattern, 1), F.regexp_extract(link, pattern, 2)
    return F.when((story != "") & (chapter != ""), join_ids(story, chapter))


def clean_srt(c: Column, banner: str = "") -> Column:
    """C17 with F16: subtitle lines without numbers and times, joined by spaces, without
    the banner and hyphens."""
    lines = F.filter(F.split(c, r"\r?\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*\d+\s*$") & ~x.rlike(r"-->"))
    out = F.replace(F.array_join(lines, " "), F.lit("-"), F.lit(""))
    return F.replace(out, F.lit(banner), F.lit("")) if banner else out


def document_type(name: Column) -> Column:
    """By the first of three letters, in this order, that a document's id has
    anywhere."""
    return F.when(name.contains("c"), "comision").when(name.contains("d"), "camara").when(name.contains("s"), "senado").otherwise("asamblea")


def drop_refs(c: Column) -> Column:
    """From the first opening to the last closing tag of a line."""
    return F.regexp_replace(c, r"(?i)<ref>.*</ref>", "")


def redirected(first: Column, final: Column, pattern: str = r"(\d+)") -> Column:
    """C20: whether two urls hold different numeric ids."""
    return F.regexp_extract(first, pattern, 1) != F.regexp_extract(final, pattern, 1)


def host(url: Column) -> Column:
    """C21."""
    return F.try_parse_url(url, F.lit("HOST"))


def ucfirst(c: Column) -> Column:
    """C25."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def lcfirst(c: Column) -> Column:
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def title_case(c: Column) -> Column:
    """C24."""
    return F.initcap(F.lower(c))


def percentage(c: Column) -> Column:
    return F.concat(F.format_number(c * 100, 0), F.lit("%"))


def duration(seconds: Column) -> Column:
    """Hours, minutes and seconds."""
    return F.format_string("%dh %dm %ds", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), (seconds % 60).cast("long"))


def long_duration(seconds: Column) -> Column:
    """Days, hours and minutes, those above zero."""
    parts = ((F.floor(seconds / 86400), "days"), (F.floor(seconds % 86400 / 3600), "hours"), (F.floor(seconds % 3600 / 60), "minutes"))
    return F.concat(*[F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name} "))).otherwise("") for n, name in parts])


def date_shown(c: Column) -> Column:
    """C24."""
    return F.date_format(c, "dd/MM/yyyy HH:mm")


def last_part(c: Column, sep: str = "/") -> Column:
    """The last segment of a composite title."""
    return F.trim(F.substring_index(c, sep, -1))


def dotted(doc: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text."""
    return F.get_json_object(doc, "$." + path)
