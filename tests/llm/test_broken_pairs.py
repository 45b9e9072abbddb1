"""Defects of answers: refusals in wordings of our own, copies of any length, languages beyond those of the tables."""

import pytest

from graphloom.llm.broken_pairs import is_copy, judge
from graphloom.llm.languages import language
from graphloom.llm.refusals import is_refusal

#: Ordinary refusals and reports of failure; none of them stands in the tables or in the module.
DECLINED = ('I cannot assist you with this.',
 'I must decline to reply to that.',
 'I am afraid I cannot tell you that.',
 'I do not have access to that data.',
 'We are unable to provide this information.',
 'That falls outside my scope.',
 "I'm not sure about that.",
 "Sorry, I don't know.",
 'I have no information on this.',
 'There is no information about this in the documents.',
 'The server returned an error.',
 'Internal server error. Please try again later.',
 'The request failed because the model is overloaded.',
 'Connection timed out.',
 "I won't answer that.",
 "I'd prefer not to say.",
 'My knowledge base does not cover this topic.',
 'Nothing in the sources mentions this.',
 'Ich weiß es leider nicht.',
 'Darüber habe ich keine Informationen.',
 'Je ne sais pas.',
 "Je n'ai pas d'information à ce sujet.",
 'No lo sé.',
 'No tengo información sobre eso.',
 'मुझे इसकी जानकारी नहीं है।',
 'இது பற்றி எனக்குத் தெரியாது.',
 '抱歉，我无法回答这个问题。',
 '申し訳ありませんが、お答えできません。',
 'ขออภัย ฉันไม่สามารถตอบคำถามนี้ได้',
 'Unable to fetch data: service unavailable.',
 "I can't share that.",
 'As an AI, I cannot give an opinion on this.',
 'I could not locate any records on that.')
ANSWERED = ('Students cannot apply after 3 May.',
 'We do not have a hostel in Zolligen.',
 'You cannot ask for a refund after the term starts.',
 'The office does not accept copies.',
 'Please contact the hostel office before 5 p.m. to collect the keys.',
 'There is no fee for final-year students.',
 'No hostel is available in Baldurin.',
 'The server room is in Block C.',
 'Our library has no parking. The annual fee is Rs. 500.',
 "I'm sorry to hear about the delay. A copy of the mark sheet goes to the School.",
 'Applications without a photo are not processed.',
 'The request must reach the office by 5 May.',
 'Late forms are not answered.',
 'My advice: submit the form to the office.',
 'Please ask Dr. Hale.')


@pytest.mark.parametrize("said", DECLINED)
def test_refusals_of_any_wording(said):
    assert is_refusal(said)


@pytest.mark.parametrize("said", ANSWERED)
def test_answers_with_a_denial_are_none(said):
    assert not is_refusal(said)


@pytest.mark.parametrize("times", (1, 2, 20, 21, 100, 3000))
def test_a_question_given_back_however_often(times):
    q = "When is the last date to submit the form?"
    assert is_copy(q, " ".join([q] * times))
    assert not is_copy(q, " ".join([q] * times) + " It is the third of May, and late forms go to the desk in Block C by noon." * times)


@pytest.mark.parametrize(("text", "code"), (
    ("Il corso inizia alla fine di maggio e la retta si paga in due rate.", "it"), ("O curso começa em maio e a taxa não é paga de uma vez.", "pt"), ("Курс начинается в мае.", "cyrillic"),
    ("De cursus begint in mei en het geld wordt niet terugbetaald.", "nl"), ("The course starts in May.", "en"), ("과정은 5월에 시작됩니다.", "ko"), ("", ""), ("Prof. Ulvane et al.", ""),
))
def test_languages(text, code):
    assert language(text)[0] == code


def test_an_answer_in_another_language():
    for answer in ("Il corso inizia alla fine di maggio e la retta si paga in due rate.", "Курс начинается в мае, и плата вносится сразу."):
        assert judge("When does the course start, and what is the fee?", answer, False)[0] == "language"
