"""Content types, character sets, base64 and response bodies as column functions."""

from __future__ import annotations

import codecs
import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import let, text_udf
from webloom.functions.text import WS

# The encodings of the public web standard by Python's names, each with its labels but for the regular
# ones, which follow. A label that is not among them is UTF-8.
ENCODINGS = {
    "utf-8": "unicode-1-1-utf-8 unicode11utf8 unicode20utf8 utf-8 utf8 x-unicode20utf8",
    "cp866": "866 cp866 csibm866 ibm866",
    "iso8859-2": "csisolatin2 iso-ir-101 iso_8859-2:1987 l2 latin2",
    "iso8859-3": "csisolatin3 iso-ir-109 iso_8859-3:1988 l3 latin3",
    "iso8859-4": "csisolatin4 iso-ir-110 iso_8859-4:1988 l4 latin4",
    "iso8859-5": "csisolatincyrillic cyrillic iso-ir-144 iso_8859-5:1988",
    "iso8859-6": "arabic asmo-708 csiso88596e csiso88596i csisolatinarabic ecma-114 iso-8859-6-e iso-8859-6-i iso-ir-127 iso_8859-6:1987",
    "iso8859-7": "csisolatingreek ecma-118 elot_928 greek greek8 iso-ir-126 iso_8859-7:1987 sun_eu_greek",
    "iso8859-8": "csiso88598e csiso88598i csisolatinhebrew hebrew iso-8859-8-e iso-8859-8-i iso-ir-138 iso_8859-8:1988 logical visual",
    "iso8859-10": "csisolatin6 iso-ir-157 l6 latin6",
    "iso8859-15": "csisolatin9 l9",
    "iso8859-16": "iso-8859-16",
    "koi8-r": "cskoi8r koi koi8 koi8-r koi8_r",
    "koi8-u": "koi8-ru koi8-u",
    "mac-roman": "csmacintosh mac macintosh x-mac-roman",
    "mac-cyrillic": "x-mac-cyrillic x-mac-ukrainian",
    "cp874": "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620 windows-874",
    "cp1252": "ansi_x3.4-1968 ascii cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 us-ascii",
    "cp1254": "csisolatin5 iso-8859-9 iso-ir-148 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 l5 latin5",
    "gb18030": "chinese csgb2312 csiso58gb231280 gb18030 gb2312 gb_2312 gb_2312-80 gbk iso-ir-58 x-gbk",
    "big5hkscs": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "euc-jp": "cseucpkdfmtjapanese euc-jp x-euc-jp",
    "iso2022-jp": "csiso2022jp iso-2022-jp",
    "cp932": "csshiftjis ms932 ms_kanji shift-jis shift_jis sjis windows-31j x-sjis",
    "cp949": "cseuckr csksc56011987 euc-kr iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949",
    "utf-16-be": "unicodefffe utf-16be",
    "utf-16-le": "csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff utf-16 utf-16le",
}
CODEC_OF = {label: name for name, labels in ENCODINGS.items() for label in labels.split()}
CODEC_OF |= {f"{form}{n}": f"iso8859-{n}" for n in (2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 15) for form in ("iso-8859-", "iso8859-", "iso8859")}
CODEC_OF |= {f"iso_8859-{n}": f"iso8859-{n}" for n in (2, 3, 4, 5, 6, 7, 8, 15)}
CODEC_OF |= {f"{form}125{n}": f"cp125{n}" for n in range(9) for form in ("cp", "windows-", "x-cp")}
TEXT_TYPES = ("application/xhtml+xml", "application/xml", "application/json")


def mime_type(content_type: Column) -> Column:
    return F.regexp_replace(F.split_part(content_type, F.lit(";"), F.lit(1)), rf"\A{WS}+|{WS}+\z", "")


def accepts_content_type(content_type: Column) -> Column:
    """Text, XHTML, XML and JSON; an absent or empty type passes. Case matters."""
    mime = mime_type(F.coalesce(content_type, F.lit("")))
    return (mime == "") | F.startswith(mime, F.lit("text/")) | mime.isin(*TEXT_TYPES)


def extract_charset(content_type: Column) -> Column:
    """The first non-empty charset parameter in lower case, without double quotes around it; null without one."""
    params = F.slice(F.split(content_type, ";", -1), 2, 2**30)
    values = F.transform(params, lambda p: F.regexp_replace(F.lower(F.regexp_extract(p, rf"(?is)\A{WS}*charset={WS}*(.*?){WS}*\z", 1)), r"\A\"+|\"+\z", ""))
    return F.get(F.filter(values, lambda v: v != ""), F.lit(0))


def decode_base64(b64: Column) -> Column:
    """struct(text, error): white space is dropped; what is no base64 or no UTF-8 is an error."""
    raw = F.try_to_binary(F.regexp_replace(b64, WS + "+", ""), F.lit("base64"))

    def found(raw: Column, text: Column) -> Column:
        error = F.when(b64.isNull(), None).when(raw.isNull(), "Content decode error: invalid base64").when(text.isNull(), "Content decode error: binary file (not UTF-8)")
        return F.struct(text.alias("text"), error.alias("error"))

    return let(raw, lambda r: let(F.try_validate_utf8(r.cast("string")), lambda t: found(r, t)))


#: Byte-order marks; one of them counts more than the label of an encoding other than UTF-8.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"))
# Where the web's tables depart from Python's.
PATCHES = {"koi8-u": {0xAE: "\u045e", 0xBE: "\u040e"}}
USER_DEFINED = "x-user-defined"
#: Labels of encodings that are not decoded: any bytes are one replacement character.
REPLACED = "replacement"
CODEC_OF |= {USER_DEFINED: USER_DEFINED} | dict.fromkeys("csiso2022kr hz-gb-2312 iso-2022-cn iso-2022-cn-ext iso-2022-kr replacement".split(), REPLACED)


@cache
def byte_table(name: str) -> str | None:
    """The 256 characters of a single-byte encoding: bytes from 80 to 9F that a Windows code page leaves open are control
    characters, other open ones are replaced. None for encodings of more bytes."""
    if name == USER_DEFINED:
        return "".join(chr(b if b < 128 else 0xF700 + b) for b in range(256))
    if not re.match(r"cp(?:125|866|874)|iso8859|koi8|mac", name):
        return None
    patch = PATCHES.get(name, {})
    one = lambda b: bytes([b]).decode(name, errors="replace")
    return "".join(patch.get(b) or (chr(b) if 0x80 <= b < 0xA0 and one(b) == "\ufffd" and name.startswith("cp") else one(b)) for b in range(256))


def decode(body: bytes, label: str | None) -> str:
    name = CODEC_OF.get((label or "utf-8").strip("\t\n\f\r ").lower(), "utf-8")
    if name == "utf-8":
        return body.decode("utf-8", errors="replace")
    for mark, marked in MARKS:
        if body.startswith(mark):
            return body[len(mark) :].decode(marked, errors="replace")
    if name == REPLACED:
        return "\ufffd" if body else ""
    table = byte_table(name)
    return codecs.charmap_decode(body, "replace", table)[0] if table else body.decode(name, errors="replace")


@text_udf("string")
def _decode(body: bytes | None, charset: str | None) -> str | None:
    return None if body is None else decode(bytes(body), charset)


def decode_body(body: Column, charset: Column) -> Column:
    """Bytes as text, wrong ones replaced: UTF-8 where no or an unknown charset is named. A byte-order mark decides about bytes
    of any other charset."""
    plain = charset.isNull() | charset.isin("utf-8", "utf8")
    return F.when(plain, F.make_valid_utf8(body.cast("string"))).otherwise(_decode(F.when(~plain, body), charset))  # every row goes to Python, but only these bodies


def error_message(body: Column) -> Column:
    """The JSON field `message`, else the first 200 characters."""
    return F.coalesce(F.get_json_object(body, "$.message"), F.left(body, F.lit(200)))
