"""Relational operators over the line and page relations."""
