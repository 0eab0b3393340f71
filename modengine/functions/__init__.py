"""Column functions: text cleaning, tagging, hashing draws, text attacks."""
