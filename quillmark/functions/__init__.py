"""Part of quillmark: functions."""
