"""Error categories and problem families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col


def _any(text: Column, *words: str) -> Column:
    """True if the text holds one of the words; one pattern per rule keeps generated code small."""
    return text.rlike("|".join(words))


def error_category(type_name, message) -> Column:
    """Category of an exception from its type name and text; first rule wins."""
    name = F.lower(F.coalesce(_col(type_name), F.lit("")))
    text = F.concat_ws(" ", name, F.lower(F.coalesce(_col(message), F.lit(""))))
    return (
        F.when(name == "", F.lit("unknown"))
        .when(_any(text, "timeout", "timed out"),
              F.when(_any(text, "http", "ssl", "connect"), "network_timeout").otherwise("timeout"))
        .when(_any(text, "connection", "dns", "name resolution", "network"), "network_connection")
        .when(_any(text, "429", "too many requests", "rate limit"), "rate_limit")
        .when(_any(text, "invalidtranslationresponseerror", "translation provider response rejected"),
              "translation_provider_response")
        .when(name == "filenotfounderror", "file_not_found")
        .when(name == "permissionerror", "permission_denied")
        .when(name == "calledprocesserror", "subprocess_failed")
        .otherwise(name))


def problem_family(event, category=None, command=None) -> Column:
    """Family of an event: the exception's category, else by words in its name."""
    event = F.lower(F.coalesce(_col(event), F.lit("")))
    category = F.lit("") if category is None else F.coalesce(_col(category), F.lit(""))
    command = F.lit("") if command is None else F.coalesce(_col(command), F.lit(""))
    media_tool = command.rlike(r"(?i)(^|[\\/ ])ff(?:mpeg|probe)(?:\.exe)?(?:$| )")
    return (
        F.when(category != "", category)
        .when(_any(event, "network", "timeout", "connection", "http"), "network")
        .when(_any(event, "validation") & _any(event, "video", "media", "output"), "media_validation")
        .when(_any(event, "ffmpeg", "ffprobe", "subprocess", "encoder", "mux") | media_tool, "external_process")
        .when(_any(event, "translation", "translator"), "translation")
        .when(_any(event, "tts", "voice", "audio"), "text_to_speech")
        .when(_any(event, "cache", "checkpoint", "recovery"), "recovery_and_cache")
        .when(_any(event, "file", "path", "batch", "input", "output"), "file_pipeline")
        .when(_any(event, "worker", "application", "app_", "session"), "application")
        .otherwise("runtime"))
