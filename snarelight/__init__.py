"""snarelight: phishing-URL triage analytics as Spark jobs."""

from snarelight.model import Tables

__all__ = ["Tables"]
