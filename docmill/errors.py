"""Errors with the HTTP-like codes of the document API. Wrapping with a new code replaces the old one."""

from __future__ import annotations


class DocError(Exception):
    code = 500

    def __init__(self, message: str, code: int | None = None):
        super().__init__(message)
        self.code = code or type(self).code
        self.messages = [message]

    def to_dict(self) -> dict:
        return {"code": self.code, "messages": self.messages}


class Internal(DocError):
    code = 500


class NotFound(DocError):
    code = 404


class Forbidden(DocError):
    code = 403


class Validation(DocError):
    code = 400


class Unauthorized(DocError):
    code = 401


def wrap(error: Exception, code: int | None, message: str) -> DocError:
    """The error with one more message; a code that is given replaces the error's own."""
    out = DocError(message, code or getattr(error, "code", 500))
    out.messages = [*getattr(error, "messages", [str(error)]), message]
    return out
