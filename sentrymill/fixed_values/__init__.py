"""Tables whose values are part of the results (rule names, texts, constants)."""
