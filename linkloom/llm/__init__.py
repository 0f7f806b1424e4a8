"""Operators for preparing training corpora (see README, section "Corpus operators")."""
