"""Rules as data, their validation and normal form, and their lowering to plans."""
