"""Readers and writers: fact catalog, source trees, rules, diffs, findings."""
