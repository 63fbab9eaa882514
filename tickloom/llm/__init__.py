"""Operators for preparing training data: counting, mixing, scoring, encoding, scanning, fingerprinting and joining texts."""
