"""Column functions: pattern catalogue, validators, span expressions, tokens and surrogates."""
