"""Landed inputs: pages, source definitions, request plans, exports."""
