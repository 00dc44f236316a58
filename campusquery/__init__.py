"""Analytics over a catalogue of universities, degrees, study plans and courses, on PySpark."""
