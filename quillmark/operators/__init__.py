"""Part of quillmark: operators."""
