"""Operations for building training corpora. Nothing else in quillmark imports this package."""
