"""Query language, query trees and the plans made of them."""
