"""Text expressions: link keys, client addresses, file types, notification texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A link is identified by its part up to the first marker found, tried in this order.
LOGIN_MARKER = "loginPortalForm.sms"
LINK_MARKERS = (LOGIN_MARKER, "DLPCenterEDR", "DLPCenter", "/cm")

# Fixed value: prefix of an IPv4 address written as IPv6.
MAPPED_ADDRESS = "::ffff:"

# Content type by file name extension.
MIME_TYPES = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "webp": "image/webp",
    "webp2": "image/webp",
}
DEFAULT_MIME_TYPE = "application/octet-stream"

# Notification texts.
DEFAULT_TYPE = "default"
READ_LABEL, UNREAD_LABEL = "읽음", "안읽음"
READ_CLASS, UNREAD_CLASS = "read", "unread"
SUMMARY_LENGTH = 50
SUMMARY_MORE = "..."
NO_ACTION_URLS = ("", "null", "undefined")
POPUP_PATH = "/push-popup"


def link_key(url: Column) -> Column:
    """The part of a URL that identifies the linked system; the whole URL without a marker."""
    key = url
    for marker in reversed(LINK_MARKERS):
        cut = F.concat(F.substring_index(url, marker, 1), F.lit(marker))
        key = F.when(url.contains(marker), cut).otherwise(key)
    return key


def is_login_link(url: Column) -> Column:
    return url.contains(LOGIN_MARKER)


def client_ip(address: Column) -> Column:
    """The address without the IPv4-in-IPv6 prefix."""
    return F.when(
        address.contains(MAPPED_ADDRESS), F.split_part(address, F.lit(MAPPED_ADDRESS), F.lit(2))
    ).otherwise(address)


def mime_type(name: Column) -> Column:
    """Content type by the text after the last dot; a name without a dot counts as extension."""
    extension = F.lower(F.element_at(F.split(name, r"\."), -1))
    result = None
    for known, kind in MIME_TYPES.items():
        result = (F if result is None else result).when(extension == known, F.lit(kind))
    return result.otherwise(F.lit(DEFAULT_MIME_TYPE))


def stored_type(kind: Column) -> Column:
    """The type to store: an empty or missing one is `default`."""
    return F.coalesce(F.nullif(kind, F.lit("")), F.lit(DEFAULT_TYPE))


def stored_url(url: Column) -> Column:
    return F.nullif(url, F.lit(""))


def type_label(kind: Column) -> Column:
    return F.upper(stored_type(kind))


def summary(message: Column) -> Column:
    """First 50 characters (code points), with dots if there are more; empty if missing."""
    cut = F.substring(message, 1, SUMMARY_LENGTH)
    more = F.when(F.length(message) > SUMMARY_LENGTH, F.lit(SUMMARY_MORE)).otherwise(F.lit(""))
    return F.coalesce(F.concat(cut, more), F.lit(""))


def read_label(is_read: Column) -> Column:
    return F.when(is_read, F.lit(READ_LABEL)).otherwise(F.lit(UNREAD_LABEL))


def read_class(is_read: Column) -> Column:
    return F.when(is_read, F.lit(READ_CLASS)).otherwise(F.lit(UNREAD_CLASS))


def fill_first(template: Column, marker: str, value: Column) -> Column:
    """Put `value` in place of the first `marker`, literally; a missing value reads `null`."""
    at = F.locate(marker, template)
    filled = F.concat(
        F.substring(template, F.lit(1), at - 1),
        F.coalesce(value, F.lit("null")),
        F.substring(template, at + len(marker), F.length(template)),
    )
    return F.when(at > 0, filled).otherwise(template)


def rendered(template: Column, title: Column, message: Column) -> Column:
    """Title first, so a title that holds the message marker gets the message."""
    return fill_first(fill_first(template, "{{title}}", title), "{{message}}", message)


def has_action(url: Column) -> Column:
    return url.isNotNull() & ~F.coalesce(url, F.lit("")).isin(*NO_ACTION_URLS)


def popup_url(ip: Column, push_id: Column) -> Column:
    return F.concat(F.lit(f"{POPUP_PATH}?ip="), ip, F.lit("&newPushId="), push_id.cast("string"))


def push_payload(push_id, kind, title, message, ip) -> Column:
    """The pushed record as JSON; a missing title or message is left out."""
    return F.to_json(
        F.struct(
            push_id.alias("id"),
            stored_type(kind).alias("type"),
            title.alias("title"),
            message.alias("message"),
            popup_url(ip, push_id).alias("url"),
        )
    )


def tag_label(tag: Column, count: Column) -> Column:
    return F.concat(tag, F.lit("("), count.cast("string"), F.lit(")"))
