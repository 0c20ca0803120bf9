"""Part of quillmark: plans."""
