"""Part of quillmark: sources."""
