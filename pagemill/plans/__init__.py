from pagemill.plans.recognize import NoBackend, Recognizer, StubRecognizer, recognize
from pagemill.plans.run import Run

__all__ = ["NoBackend", "Recognizer", "Run", "StubRecognizer", "recognize"]
