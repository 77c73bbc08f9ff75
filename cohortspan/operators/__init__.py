"""One module per operator family: clean, collapse, impute, transform, stratify, model, score."""
