"""folioflow: catalogues collected from many web sources, as Spark DataFrame jobs."""

from folioflow.session import build_session, prepare

__all__ = ["build_session", "prepare"]
