"""quillspark: conversation and corpus analytics as plain Spark DataFrame plans."""
