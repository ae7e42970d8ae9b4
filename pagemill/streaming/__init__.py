from pagemill.streaming.continuous import continuous_import

__all__ = ["continuous_import"]
