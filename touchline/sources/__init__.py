"""Readers: raw text, topics, the match_events table, ledgers and rosters."""
