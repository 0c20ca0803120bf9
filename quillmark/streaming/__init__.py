"""Part of quillmark: streaming."""
