"""Operators over free text. Nothing outside this subpackage imports it."""
