"""Operators for preparing text at training scale. Nothing outside this subpackage imports it."""
