"""Errors as values: kinds, messages and exit codes (1: the user's, 2: internal)."""

from __future__ import annotations

from http import HTTPStatus

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exit code by area and kind.
EXIT_CODES = {
    "fetch": {"InvalidScheme": 1, "InvalidUrl": 1, "InternalHost": 1, "UnsupportedContentType": 1, "Playwright": 1, "Timeout": 2, "DnsResolution": 2, "Http": 2, "Status": 2, "TooLarge": 2},
    "repo": {"NotFound": 1, "InvalidRepo": 1, "InvalidRef": 1, "InvalidPath": 1, "InvalidLineRange": 1, "InvalidPattern": 1, "RateLimited": 1, "Forbidden": 1, "Api": 2, "Network": 2, "Decode": 2},
    "search": {"ApiKeyNotSet": 1, "RateLimited": 1, "QuotaExhausted": 1, "Api": 2, "Network": 2},
    "chat": {"TokenNotSet": 1, "Api": 1, "Network": 2, "Timeout": 2, "Decode": 2},
}
# Message by area and kind; {} takes the detail.
MESSAGES = {
    "fetch": {
        "InvalidScheme": "invalid URL: must be HTTP(S)",
        "InvalidUrl": "invalid URL: {}",
        "InternalHost": "blocked: internal/private host not allowed",
        "Http": "fetch failed: {}",
        "DnsResolution": "DNS resolution failed: {}",
        "Status": "fetch failed: status {}",
        "UnsupportedContentType": "unsupported content type: {} (expected text/HTML)",
        "TooLarge": "response too large (>10000000 bytes)",
        "Timeout": "fetch timed out: {}",
        "Playwright": "playwright rendering failed: {}",
    },
    "repo": {
        "NotFound": "Not found: {}",
        "RateLimited": "GitHub API rate limit exceeded. Set GITHUB_TOKEN or run `gh auth login` for higher limits.",
        "Forbidden": "Access denied: {} — check that your GITHUB_TOKEN has the required scopes",
        "Api": "GitHub API error {}",
        "Network": "Network error: {}",
        "InvalidRepo": "Invalid repository format: expected 'owner/repo', got '{}'",
        "InvalidRef": "Invalid ref: {}",
        "InvalidPath": "Invalid path: {}",
        "InvalidLineRange": "Invalid line range: '{}'. Use formats like '1-80', '50-', or '100' (first N lines).",
        "InvalidPattern": "Invalid glob pattern: {}",
        "Decode": "Content decode error: {}",
    },
    "search": {
        "ApiKeyNotSet": "GEMINI_API_KEY not set. Get one at https://aistudio.google.com/apikey",
        "RateLimited": "API rate limit exceeded. Please retry later.",
        "QuotaExhausted": "API quota exhausted: {} — check your API billing at https://aistudio.google.com",
        "Api": "API error {}",
        "Network": "Network error: {}",
    },
    "chat": {
        "TokenNotSet": "SLACK_TOKEN is not set — export a User OAuth token (xoxp-…)",
        "Api": "Slack API error: {}",
        "Network": "Slack request failed: {}",
        "Timeout": "Slack fetch timed out: {}",
        "Decode": "Slack response decode error: {}",
    },
}


# Reasons that are worded otherwise than in Python's table.
REASONS = {413: "Payload Too Large", 414: "URI Too Long", 416: "Range Not Satisfiable", 418: "I'm a teapot", 422: "Unprocessable Entity"}


def status_line(status: Column) -> Column:
    """A status with its reason, as in '404 Not Found'."""
    reasons = {x.value: x.phrase for x in HTTPStatus} | REASONS
    table = F.create_map(*[F.lit(x) for pair in reasons.items() for x in pair])
    return F.concat(status.cast("string"), F.lit(" "), F.coalesce(F.try_element_at(table, status), F.lit("<unknown status code>")))


class PipelineError(Exception):
    """An error at the edge of the library, with its exit code."""

    def __init__(self, message: str, exit_code: int = 2):
        super().__init__(message)
        self.exit_code = exit_code

    @classmethod
    def user(cls, message: str) -> PipelineError:
        return cls(message, 1)


def exit_code(area: str, kind: Column) -> Column:
    """The exit code of a kind; an unknown kind is internal, null stays null."""
    table = F.create_map(*[F.lit(x) for pair in EXIT_CODES[area].items() for x in pair])
    return F.when(kind.isNotNull(), F.coalesce(F.try_element_at(table, kind), F.lit(2)))


def message(area: str, kind: Column, detail: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MESSAGES[area].items() for x in pair])
    return F.replace(F.try_element_at(table, kind), F.lit("{}"), F.coalesce(detail, F.lit("")))


def error(area: str, kind: Column, detail: Column) -> Column:
    """struct(kind, message, exit_code), null where kind is null."""
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), message(area, kind, detail).alias("message"), exit_code(area, kind).alias("exit_code")))


ERROR = "struct<kind:string,message:string,exit_code:int>"


def search_status(status: Column, body: Column) -> Column:
    """Kind of a search response's error, or null: limits by status, then the body's own error object."""
    code = F.get_json_object(body, "$.error.code").try_cast("int")
    own = classify_api_error(F.get_json_object(body, "$.error").isNotNull(), code)
    return F.when(status == 429, "RateLimited").when((status < 200) | (status > 299), F.coalesce(own, F.lit("Api"))).otherwise(own)


def classify_api_error(has_error: Column, code: Column) -> Column:
    return F.when(has_error, F.when(code == 429, "RateLimited").when(code == 403, "QuotaExhausted").otherwise("Api"))


def repo_status(status: Column, remaining: Column) -> Column:
    """Kind of a repository API error by status and the remaining quota, or null."""
    return F.when(status.between(200, 299), None).when(status == 404, "NotFound").when(status == 429, "RateLimited").when(status == 403, F.when(remaining == 0, "RateLimited").otherwise("Forbidden")).otherwise("Api")


def is_retriable(kind: Column, code: Column, transient: Column) -> Column:
    """Limits, server errors and lost connections are worth another try."""
    return F.coalesce((kind == "RateLimited") | ((kind == "Api") & code.between(500, 599)) | ((kind == "Network") & transient), F.lit(False))


def note_failed(label: str, error_text: Column) -> Column:
    """A note on an optional section that failed, null where it did not."""
    return F.when(error_text.isNotNull(), F.concat(F.lit(f"Could not fetch {label} ("), error_text, F.lit(")")))
