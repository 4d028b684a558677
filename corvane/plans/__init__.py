"""Registered queries, by subject."""

from corvane.plans import library, records, works

MODULES = [records, library, works]
