"""Registers the queries: importing this package fills ``evenspan.registry``."""

from . import assembly, attention, corpus, encoding, functions, jobs, legacy, services, similarity, sources, statistics  # noqa: F401
