"""Relational, graph, taint, trace and incremental operators over fact tables."""
