"""What a file is, from its bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.operators.packages import ole_type, ooxml_type

#: fixed values: media types that only say that a file is a package or a compound file
GENERIC_ZIP, GENERIC_OLE = ("application/zip", "application/x-zip-compressed"), ("application/CDFV2", "application/x-ole-storage", "application/vnd.ms-office")
#: fixed values: media types by the bytes that files start with, in hexadecimal
MAGIC = {
    "255044462D": "application/pdf",
    "504B0304": "application/zip",
    "D0CF11E0A1B11AE1": "application/x-ole-storage",
    "89504E470D0A1A0A": "image/png",
    "FFD8FF": "image/jpeg",
    "47494638": "image/gif",
    "1F8B": "application/gzip",
}
#: header names of mail, three of which a message must have
MAIL_HEADERS = ("from", "to", "subject", "date", "message-id", "received", "mime-version")
#: media types that convert; others are deferred
SUPPORTED = ("application/pdf", "message/rfc822", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/vnd.ms-excel", "application/msword")
#: code: (outcome, reason)
OUTCOMES = {"password-required": ("blocked", "password-protected"), "zero-page": ("blocked", "degenerate-input"), "ok": ("processable", None)}


def sniffed(content: Column) -> Column:
    """struct<media_type, flags>: by magic, PDF's anywhere in the first 1,024 bytes, else text if it is UTF-8 without NUL."""
    head = F.hex(F.substring(content, 1, 1024))
    kind = F.when(F.length(head) == 0, F.lit(None))
    for magic, media in MAGIC.items():
        kind = kind.when(head.startswith(magic), media)
    start = F.substring(content, 1, 1024)
    pdf = F.contains(start, F.lit(b"%PDF-"))
    plain = ~F.contains(start, F.lit(b"\x00")) & F.is_valid_utf8(content.cast("string"))
    kind = kind.when(pdf, "application/pdf").when(plain, "text/plain")
    return F.struct(F.coalesce(kind, F.lit("application/octet-stream")).alias("media_type"), F.when(kind.isNull(), F.array(F.lit("media-type-unknown"))).otherwise(F.array().cast("array<string>")).alias("flags"))


def looks_like_mail(text: Column) -> Column:
    """Whether the lines before the first blank one are headers, three known ones among them."""
    block = F.element_at(F.split(F.replace(F.substring(text, 1, 8192), F.lit("\r\n"), F.lit("\n")), "\n\n"), 1)
    lines = F.split(block, "\n")
    known = F.array_intersect(F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.lower(F.substring_index(x, ":", 1))), F.array(*map(F.lit, MAIL_HEADERS)))
    return F.forall(lines, lambda x: x.contains(":") | x.rlike("^[ \t]")) & (F.size(known) >= 3)


def refined(media_type: Column, text: Column, names: Column | None = None) -> Column:
    """Plain text and PDFs that are mail are mail; packages and compound files are what their parts or streams (names) say."""
    mail = media_type.isin("text/plain", "application/pdf") & F.coalesce(looks_like_mail(text), F.lit(False))
    out = F.when(mail, "message/rfc822")
    if names is not None:
        out = out.when(media_type.isin(*GENERIC_ZIP), F.coalesce(ooxml_type(names), media_type)).when(media_type.isin(*GENERIC_OLE), F.coalesce(ole_type(names), media_type))
    return out.otherwise(media_type)


def supported(media_type: Column) -> Column:
    return media_type.isin(*SUPPORTED) | media_type.rlike("^(text|image|audio|video)/")


def outcome(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, (what, _) in OUTCOMES.items():
        out = F.when(code == k, what).otherwise(out)
    return F.coalesce(out, F.lit("failed"))


def exit_code(what: Column) -> Column:
    """Of a conversion's outcome: 0 done, 3 blocked, 4 deferred, 5 failed."""
    return F.when(what == "processable", 0).when(what == "blocked", 3).when(what == "deferred", 4).otherwise(5)
