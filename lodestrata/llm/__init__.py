"""Operations on training text, each with a query registered by ``queries``."""
